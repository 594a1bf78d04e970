import random

from conftest_llm import empty

from segmart.llm.license_texts import TEMPLATES
from segmart.llm.licenses import LicenceSettings, Templates, license_scan, stated_licence, words_of

SCAN = Templates(TEMPLATES, LicenceSettings())


def confirmed(text):
    return [(name, text[start:end]) for start, end, name, _, sure, *_ in SCAN.find(text) if sure]


def test_every_template_is_found_as_itself():
    for name, text in TEMPLATES.items():
        assert [found for found, _ in confirmed(f"Some words before it.\n{text}\nAnd ordinary words after.")] == [name]


def test_changed_layout_case_and_words():
    text = TEMPLATES["MIT"].replace("\n", "\n * ").upper().replace("CHARGE", "MONEY")
    ((start, end, name, saved, sure, share, missing, extra),) = SCAN.find(text)
    assert (name, sure, missing, extra) == ("MIT", True, "charge", "money")
    assert saved > 0.8 and share > 0.98


def test_versions_are_told_apart():
    for version in (2, 3):
        ((name, _),) = confirmed(f"This work is licensed under the GNU General Public License, version {version}.")
        assert name == f"GPL-{version}.0 statement"


def test_full_notices_with_names_are_confirmed():
    text = TEMPLATES["BSD-3-Clause"].replace("the copyright holder nor", "Acme Widgets nor")
    text = text.replace("BY THE COPYRIGHT HOLDERS AND", "BY\nJANE ROE, ACME WIDGETS\nAND")
    assert [name for name, _ in confirmed(f"Copyright 2001 Acme\n\n{text}\nint main")] == ["BSD-3-Clause"]
    text = text.replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "\nJANE ROE, ACME WIDGETS\n")
    assert [name for name, _ in confirmed(text)] == ["BSD-3-Clause"]
    for name in ("GPL-2.0-or-later with address", "LGPL-3.0-or-later with copy", "AGPL-3.0-or-later"):
        assert [found for found, _ in confirmed("\n".join(TEMPLATES[name].split(". ")))] == [name]


def test_other_lines_leave_notices_apart():
    text = f"{TEMPLATES['MIT']}\nzebras graze quietly\nthe copyright of zebras\nzebras graze\nReleased under the MIT License."
    assert [name for name, _ in confirmed(text)] == ["MIT", "MIT statement"]


def test_mentions_are_not_confirmed():
    text = "I have a licence to fish, and permission of my mother to redistribute it."
    assert confirmed(text) == [] and len(list(SCAN.find(text))) == 1


def test_statements_name_their_licence():
    named = {
        "Distributed under the MIT license.": "MIT",
        "This project is licensed under the MIT License - see LICENSE.": "MIT",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0-only",
        "Licensed under the GNU GPL v2 or later.": "GPL-2.0-or-later",
        "Released under the terms of the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Available under the 3-clause BSD license": "BSD-3-Clause",
        "Licensed under CC BY-NC-SA 4.0, see below": "CC-BY-NC-SA-4.0",
    }
    for text, name in named.items():
        assert [found.removesuffix(" statement") for found, _ in confirmed(text)] == [name]
    several = ["Licensed under MIT or Apache-2.0.", "SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under the MIT-0 license"]
    several += ["Licensed under the GPL 2.1", "Licensed under the Acme License, not the MIT License", "I like the MIT licence"]
    for text in several:
        assert stated_licence(text) is None and confirmed(text) == []


def brute_force(words):
    """The template with the closest wording of all, if it is close enough: no ranking, no test by counts."""
    shares = {name: SCAN.difference(words, name)[0] for name in TEMPLATES}
    best = max(shares.values())
    return {name for name, share in shares.items() if share == best and share >= 0.9}


def test_every_template_that_could_be_confirmed_is_compared():
    draw = random.Random(4)
    for name, text in TEMPLATES.items():
        for _ in range(6):
            words = words_of(text)
            for _ in range(draw.randint(0, len(words) // 8)):
                place = draw.randrange(len(words))
                words[place : place + draw.randint(0, 1)] = draw.choices(["other", "software", "the", "license"], k=draw.randint(0, 1))
            if not words:
                continue
            found, _, sure, *_ = SCAN.best(words)
            want = brute_force(words)
            assert found in want if want else not sure


def test_place_in_a_long_run_does_not_matter():
    # Words of licences without a beginning of a template, so that all of it is one run.
    filler = "the software and the license of the work in any form or for any purpose"
    notice = TEMPLATES["ISC"].replace("Permission to use", "You have permission to use")
    for before in (0, 1, 7, 15, 16, 17, 18, 29, 40, 300):
        text = "\n".join([filler] * before + [notice] + [filler] * 40)
        ((name, block),) = confirmed(text)
        assert name == "ISC" and block.startswith("permission to use, copy") and block.endswith("THIS SOFTWARE")
    two = "\n".join([filler] * 50 + [notice] + [filler] * 5 + [notice.replace("\n", " ")] + [filler] * 50)
    assert [name for name, _ in confirmed(two)] == ["ISC", "ISC"]


def test_repeated_notices_and_long_texts():
    line = "Released under the MIT License."
    assert len(confirmed("\n".join([line] * 500))) == 500
    long = "plain words go on " * 20_000 + "\n" + line
    assert [block for _, block in confirmed(long)] == [line]


def test_edges(spark, edges):
    assert license_scan(edges).count() == 0
    assert license_scan(empty(edges)).count() == 0
    rows = [(None, "Licensed under CC BY 4.0.", 1), (1, None, 2), (2, "Licensed under CC BY 4.0.", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = license_scan(df).collect()
    assert sorted(str(r.doc_id) for r in found) == ["2", "None"]
    assert all(r.confirmed and (r.start, r.end) == (0, 25) for r in found)
