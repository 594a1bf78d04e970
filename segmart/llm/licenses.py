"""Licences: candidate blocks are compressed with each template as dictionary; wording confirms the winner."""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import columns_as
from segmart.llm.license_texts import NAMES, TEMPLATES

_CUE = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|public domain|rights reserved|\bcc[ -]by|\bcc0"
_CUES = re.compile(_CUE)
# A unit is a line, or a sentence within one; an identifier stays with its mark.
_UNIT = re.compile(r"[^\n]+?(?:(?:[.!?;]|(?<!License-Identifier):)(?=\s)|(?=\n)|\Z)")
_WORD = re.compile(r"[^\W_]+")
_ROW_BATCH = 256
_SHINGLE = 4
# What a statement says before the name of its licence.
_STATED = re.compile(
    r"\b(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:under|by|with) (?:the )?"
    r"(?:(?:terms|conditions)(?: and conditions)? of )?(?:the )?",
    re.I,
)
_NAMES = {name: re.compile(pattern + r"(?![\w.]*\d)(?!-\w)", re.I) for name, pattern in NAMES.items()}
# Further names later in a sentence, as they are written: "mit" is a word elsewhere.
_WRITTEN = {name: re.compile(r"(?<![\w-])" + pattern.pattern) for name, pattern in _NAMES.items()}
_SENTENCE_END = re.compile(r"[.!?;](?=\s|$)|\n|$")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)[ \t]*(?:\*/|-->)?[ \t]*$", re.M)
_SPDX_MARK = "SPDX-License-Identifier"


@dataclass(frozen=True)
class LicenceSettings:
    # Share of the template's words that a confirmed block has, in order, and of the block's that the template has.
    wording: float = 0.9
    # Blocks of up to so many words are statements if they name one licence exactly.
    statement_words: int = 40
    # Share of a unit's words that are words of templates, for a unit without a cue to go on with a block.
    vocabulary: float = 0.8
    level: int = 9


def words_of(text: str) -> list[str]:
    return [word.lower() for word in _WORD.findall(text)]


def stated_licence(text: str) -> str | None:
    """The one licence that a statement or an identifier line names, None without or with several."""
    tags = set(_SPDX.findall(text))
    if _SPDX_MARK in text:
        # A line with an expression of several identifiers is none of them.
        return tags.pop() if len(tags) == 1 and text.count(_SPDX_MARK) == len(_SPDX.findall(text)) else None
    found = set()
    for said in _STATED.finditer(text):
        named = {name: match for name, pattern in _NAMES.items() if (match := pattern.match(text, said.end()))}
        for name, match in named.items():
            stop = _SENTENCE_END.search(text, match.end()).start()
            named_too = any(p.search(text, match.end(), stop) for other, p in _WRITTEN.items() if other != name)
            found.add(None if named_too else name)
        found |= set() if named else {None}
    return found.pop() if len(found) == 1 else None


class Templates:
    def __init__(self, texts: Mapping[str, str], settings: LicenceSettings) -> None:
        self.settings = settings
        self.words = {name: words_of(text) for name, text in texts.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.longest = max(map(len, self.words.values()))
        self.vocabulary = {word for words in self.words.values() for word in words}
        self.starts = {tuple(words[:4]) for words in self.words.values()}
        self.exact = {tuple(words) for words in self.words.values()}
        self.longest_run = int(1.5 * self.longest)
        self.places: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            for i in range(len(words) - _SHINGLE + 1):
                self.places.setdefault(tuple(words[i : i + _SHINGLE]), []).append((name, i))
        plain = {"level": settings.level, "write_content_size": False, "write_checksum": False}
        self.plain = zstandard.ZstdCompressor(**plain)
        # Normal form on both sides, so that layout and case cost no bytes.
        self.primed = {
            name: zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                write_dict_id=False,
                **plain,
            )
            for name, words in self.words.items()
        }

    def rank(self, words: list[str]) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save; ties by name."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        saved = [(1 - len(coder.compress(data)) / alone, name) for name, coder in self.primed.items()]
        return sorted(saved, key=lambda entry: (-entry[0], entry[1]))

    def difference(self, words: list[str], name: str) -> tuple[float, list[str], list[str]]:
        """Smaller share of equal words of both sides, words only the template has, words only the block has."""
        template = self.words[name]
        matcher = difflib.SequenceMatcher(None, template, words, autojunk=False)
        missing, extra, equal = [], [], 0
        for tag, a, b, c, d in matcher.get_opcodes():
            if tag == "equal":
                equal += b - a
            else:
                missing += template[a:b]
                extra += words[c:d]
        return equal / max(len(template), len(words)), missing, extra

    def blocks(self, text: str) -> Iterator[tuple[int, int, list[str], bool]]:
        """(start, end, words, whether one has a cue) of runs of units in the words of licences.

        A run ends before a unit that begins like a template and around a unit that is one. Notices inside a
        run much longer than the longest template are found by their own words, see ``parted``.
        """
        for start, end, run, cued in self.runs(text):
            if len(run) > self.longest_run:
                yield from self.parted(text, start, end)
            else:
                yield start, end, run, cued

    def parted(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, list[str], bool]]:
        """A long run as the notices that lie in it and what is left between them.

        Four words that a template has tell where the template would begin. Beginnings that agree but for a
        tenth of the template are one notice, if half of the template's groups of four are there. Where a notice
        is found thus does not depend on what precedes it. What is left holds no such notice; it is cut
        into pieces for guesses.
        """
        spans = [(start + word.start(), start + word.end()) for word in _WORD.finditer(text[start:end])]
        words = [text[a:b].lower() for a, b in spans]
        taken: list[tuple[int, int]] = []
        for _, first, last in sorted(self.aligned(words), key=lambda found: (-found[0], found[1])):
            if all(last <= a or b <= first for a, b in taken):
                taken.append((first, last))
        at = 0
        for first, last in [*sorted(taken), (len(words), len(words))]:
            cuts = [*range(at, first, self.longest_run), first]
            pieces = list(zip(cuts, cuts[1:], strict=False)) + ([(first, last)] if last > first else [])
            for a, b in pieces:
                left, right = spans[a][0], spans[b - 1][1]
                yield left, right, words[a:b], bool(_CUES.search(text, left, right))
            at = last

    def aligned(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(groups of four words in common, first word, last word + 1) of possible notices."""
        hits: dict[str, list[tuple[int, int]]] = {}
        for i in range(len(words) - _SHINGLE + 1):
            for name, place in self.places.get(tuple(words[i : i + _SHINGLE]), ()):
                hits.setdefault(name, []).append((i - place, i))
        for name, found in hits.items():
            size = len(self.words[name])
            found.sort()
            group = [found[0]]
            for hit in [*found[1:], (len(words) + 2 * size, -1)]:
                if hit[0] - group[-1][0] > size // 10 or hit[0] - group[0][0] > size // 5:
                    common = len({i for _, i in group})
                    if 2 * common >= size - _SHINGLE + 1:
                        yield common, min(i for _, i in group), max(i for _, i in group) + _SHINGLE
                    group = []
                group.append(hit)

    def runs(self, text: str) -> Iterator[tuple[int, int, list[str], bool]]:
        """Units with a cue or in the words of licences, as long as they follow each other."""
        start = end = 0
        run: list[str] = []
        cued = False
        for unit in _UNIT.finditer(text):
            words = words_of(unit[0])
            if not words:
                continue
            cue = bool(_CUES.search(unit[0]))
            known = sum(word in self.vocabulary for word in words) >= self.settings.vocabulary * len(words)
            whole = tuple(words) in self.exact
            begins = whole or tuple(words[:4]) in self.starts
            if run and (begins or not (cue or known)):
                yield start, end, run, cued
                run, cued = [], False
            if cue or known:
                if not run:
                    start = unit.start() + len(unit[0]) - len(unit[0].lstrip())
                run += words
                cued, end = cued or cue, unit.end()
                if whole:
                    yield start, end, run, cued
                    run, cued = [], False
        if run:
            yield start, end, run, cued

    def best(self, words: list[str], text: str = "") -> tuple[str, float, bool, float, list[str], list[str]]:
        """The licence of a block of these words; ``text`` is the block itself, if it may be a statement."""
        ranked, possible = self.rank(words), self.possible(words)
        looked = [(saved, name, *self.difference(words, name)) for saved, name in ranked if name in possible]
        sure = [entry for entry in looked if entry[2] >= self.settings.wording]
        # Among confirmed templates the closest wording, then the best reduction.
        if sure:
            saved, name, share, missing, extra = max(sure, key=lambda entry: entry[2])
            return name, saved, True, share, missing, extra
        # Without one, the best reduction stays a guess, unless a short block says which licence it is.
        saved, name = ranked[0]
        stated = stated_licence(text) if len(words) <= self.settings.statement_words else None
        return f"{stated} statement" if stated else name, saved, bool(stated), *self.difference(words, name)

    def possible(self, words: list[str]) -> set[str]:
        """Templates that have enough of these words, in any order, to be confirmed: no other one can be."""
        counts = Counter(words)
        return {
            name
            for name, template in self.words.items()
            if min(len(template), len(words)) >= self.settings.wording * max(len(template), len(words))
            and (self.counts[name] & counts).total() >= self.settings.wording * max(len(template), len(words))
        }

    def joined(self, text: str, blocks: list, shares: list[float], i: int) -> tuple[int, tuple] | None:
        """The number after that of the last block that block i makes a notice with, and the result of the whole.

        Blocks are joined across one unit of few template words each, if the whole is confirmed and closer
        to its template than each of them is alone.
        """
        found, words, alone, cued = None, list(blocks[i][2]), shares[i], blocks[i][3]
        for j in range(i + 1, len(blocks)):
            between = [unit for x in _UNIT.finditer(text, blocks[j - 1][1], blocks[j][0]) if (unit := words_of(x[0]))]
            gap = between[0] if len(between) == 1 else None
            words = words + (gap or []) + blocks[j][2]
            if gap is None or len(words) > self.longest_run:
                break
            alone, cued = max(alone, shares[j]), cued or blocks[j][3]
            if cued and self.possible(words):
                whole = self.best(words)
                if whole[2] and whole[3] > max(alone, found[1][3] if found else 0.0):
                    found = j + 1, whole
        return found

    def find(self, text: str) -> Iterator[tuple[int, int, str, float, bool, float, str, str]]:
        blocks = list(self.blocks(text))
        results = [self.best(words, text[start:end]) if cued else None for start, end, words, cued in blocks]
        shares = [result[3] if result and result[2] else 0.0 for result in results]
        i = 0
        while i < len(blocks):
            after, result = self.joined(text, blocks, shares, i) or (i + 1, results[i])
            if result:
                *kept, missing, extra = result
                yield blocks[i][0], blocks[after - 1][1], *kept, " ".join(missing), " ".join(extra)
            i = after


@functools.lru_cache(maxsize=4)
def _templates(texts: tuple[tuple[str, str], ...], settings: LicenceSettings) -> Templates:
    return Templates(dict(texts), settings)


_FIELDS = [
    ("start", pa.int64(), "long"),
    ("end", pa.int64(), "long"),
    ("licence", pa.string(), "string"),
    ("size_reduction", pa.float64(), "double"),
    ("confirmed", pa.bool_(), "boolean"),
    ("wording_share", pa.float64(), "double"),
    ("missing_words", pa.string(), "string"),
    ("extra_words", pa.string(), "string"),
]


def license_scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    settings: LicenceSettings | None = None,
) -> DataFrame:
    """One row per candidate block: doc_id, start, end (code points), licence, size_reduction, confirmed,
    wording_share, missing_words, extra_words.

    Templates are ranked by how much they shrink the block, and the wording of every one that could be confirmed is
    compared: the licence is the confirmed template with the closest wording. A short block that no template confirms
    but that names exactly one licence, after "licensed under" and the like or as an identifier, is confirmed as a statement
    of that licence; its words are compared with the best guess. Blocks parted by a single other line or sentence count as one where that confirms the whole;
    otherwise the licence is the best guess, ``confirmed`` false. Every block of the whole
    text counts, also a repeated one, wherever it stands in a long run of licence text. Texts without a cue, null or empty, and empty tables give no rows;
    repeated rows and rows without id are scanned one by one. Nothing is shuffled, and only texts with
    a cue leave the JVM.
    """
    settings = settings or LicenceSettings()
    fixed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _templates(fixed, settings)
        for whole in batches:
            for first in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(first, _ROW_BATCH)
                rows, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for block in scan.find(text):
                        rows.append(i)
                        found.append(block)
                columns = list(zip(*found, strict=True)) or [[] for _ in _FIELDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int32())),
                        *[pa.array(values, kind) for values, (_, kind, _) in zip(columns, _FIELDS, strict=True)],
                    ],
                    ["doc_id", *[name for name, _, _ in _FIELDS]],
                )

    source = columns_as(docs, doc_id=id_column, text=text_column)
    kind = source.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{name} {kind}" for name, _, kind in _FIELDS)
    cued = source.where(F.regexp_like("text", F.lit(_CUE)))
    return cued.mapInArrow(run, f"doc_id {kind}, {columns}")
