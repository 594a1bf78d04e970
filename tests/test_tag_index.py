"""Indexed tags against the inline expressions."""

import random

import pytest

from segmart.operators.tag_index import rule_table, tags_by_index
from segmart.operators.tags import tag_items

WORDS = ["lip", "cream", "eye", "ab", "a", "xy", "sérum", "gold ring", "ring", "o'r", "100%"]


def lines(spark, texts):
    return spark.createDataFrame([(t, "m", "s") for t in texts], "item_desc string, maincat_desc string, item_subcat_desc string")


def tags(df):
    return {r["item_desc"]: list(r["tags"]) for r in df.collect()}


def plain(texts, rules):
    return {t: [tag.upper() for tag, words in rules.items() for w in words if t is not None and w in t.lower()] for t in texts}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    made = [" ".join(draw.choices([*WORDS, "Cream", "LIP", "zz"], k=draw.randrange(1, 6))) for _ in range(300)]
    return [*made, "", " ", None, "Gold  Ring", "ÉSÉRUM", "a" * 3000, "x"]


def test_same_as_inline(spark, texts):
    rules = {"Lip": ["lip", "li"], "cream": ["cream", "CREAM"], "one": ["a", "é"], "two": ["ab", "xy"], "gold": ["gold ring", "ring", "d r"]}
    rules |= {"never": ["qqq", "lipx"], "all": [""], "odd": ["o'r", "100%", "sérum"], "lip2": ["lip"]}
    df = lines(spark, texts + texts[:50])
    indexed, inline = tag_items(df, rules, inline_keywords=0), tag_items(df, rules, inline_keywords=1000)
    assert indexed.columns == inline.columns and indexed.count() == inline.count()
    assert tags(indexed) == tags(inline) == plain(texts, rules)
    once = tags(tag_items(df, rules, distinct_tags=True, inline_keywords=0))
    assert once == tags(tag_items(df, rules, distinct_tags=True))


def test_very_many_rules(spark, texts):
    rules = {f"t{i}": [f"{WORDS[i % len(WORDS)]}{i}"] for i in range(100_000)} | {"hit": ["gold ring"]}
    table = rule_table(spark, rules)
    found = tag_items(lines(spark, [*texts, "lip0 and cream100001", "cream1 x"]), table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = tags(found)
    assert got["lip0 and cream100001"] == ["T0"] + sorted(t for t in got["lip0 and cream100001"] if t != "T0")
    assert got["cream1 x"] == ["T1"] and {t for t in texts if got[t]} == {t for t in texts if t and "gold ring" in t.lower()}


def test_no_rules_and_no_items(spark, texts):
    none = rule_table(spark, {})
    assert set(map(tuple, tags(tags_by_index(lines(spark, texts), none)).values())) == {()}
    assert tags_by_index(lines(spark, texts).where("false"), rule_table(spark, {"a": ["b"]})).count() == 0
