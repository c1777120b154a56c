"""Edit-aware token counts.

A text is kept as leaves of about LEAF characters. Most are cut between a
character that is no white space and one that is: there the vocabulary's
pattern always begins a new pre-token. Where no such place comes for a long
time (scripts written without spaces, runs of one letter or sign) a leaf is
cut within a pre-token, between two tokens of it. Such a cut holds while the
two tokens beside it are still how the vocabulary writes their bytes, because
merging by rank gives a sequence of tokens exactly if it gives each two
neighbours among them.

A segment tree over the leaves holds sums of characters and tokens. An edit
finds its leaves by descending the tree, encodes again those it touches, and
further ones beside them as long as the cut to the next one doesn't hold; it
then updates the sums above. Everything else keeps its counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .tokens import Encoder, encoder

LEAF = 256
#: Without a safe place within so many leaves' length a cut is made within a pre-token.
PATIENCE = 4
#: What a leaf beside such a cut has at least: more than an added token or a contraction reaches over it.
LEAST = 16
_BLANKS = " \t\n\r\f\v"
_CUT = re.compile(rf"(?<=\S)(?=[{_BLANKS}])")
#: Characters of which the vocabulary's pattern takes any number into one pre-token: letters, digits, signs.
_CLASSES = re.compile(
    "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])"
    r"|([0-9])|([!-&(-/:-@\[-`{-~])"
)
Edit = tuple[int, int, str]


class Leaf(NamedTuple):
    text: str
    n: int  # tokens
    first: int  # the first token's id, -1 for no text
    last: int


def _kind(char: str) -> int:
    found = _CLASSES.fullmatch(char)
    return found.lastindex if found else 0


def holds(left: str, right: str, marks: Sequence[str]) -> bool:
    """Whether a cut between `left` and `right` within a pre-token can hold, by their characters."""
    if len(left) < LEAST or len(right) < LEAST or not _kind(left[-1]) == _kind(right[0]) > 0 or "'" in left[-3:]:
        return False
    around = left[1 - LEAST :] + right[: LEAST - 1]
    return all(m not in around for m in marks)


def encoded(text: str, enc: Encoder) -> Leaf:
    ids = enc.ids(text)
    return Leaf(text, len(ids), ids[0], ids[-1]) if ids else Leaf(text, 0, -1, -1)


def within(text: str, enc: Encoder, leaf: int = LEAF) -> list[Leaf]:
    """The leaves of a text that is to be cut between its tokens, as far as such cuts hold."""
    ids, marks = enc.ids(text), enc.marks
    out: list[Leaf] = []
    data = text.encode("utf-8", "surrogatepass")
    begin = at = chars = begin_chars = begin_id = 0
    for k, i in enumerate(ids):
        # A token may end within a character; a cut needs a whole one.
        if k > begin_id and chars - begin_chars >= leaf and at < len(data) and data[at] & 0xC0 != 0x80:
            left, right = text[max(begin_chars, chars - LEAST) : chars], text[chars : chars + LEAST]
            if holds(left, right, marks):
                out.append(Leaf(text[begin_chars:chars], k - begin_id, ids[begin_id], ids[k - 1]))
                begin, begin_chars, begin_id = at, chars, k
        part = enc.token(i)
        at += len(part)
        chars += sum(byte & 0xC0 != 0x80 for byte in part)
    out.append(Leaf(text[begin_chars:], len(ids) - begin_id, ids[begin_id] if ids else -1, ids[-1] if ids else -1))
    return out


def leaves_of(text: str, enc: Encoder, leaf: int = LEAF) -> list[Leaf]:
    """The text in leaves of `leaf` characters or a little more."""
    out: list[Leaf] = []
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + leaf)
        end = cut.start() if cut else len(text)
        if end - at > PATIENCE * leaf and max(map(len, enc.marks), default=0) < LEAST:
            out += within(text[at:end], enc, leaf)
        else:
            out.append(encoded(text[at:end], enc))
        at = end
    return out or [Leaf("", 0, -1, -1)]


class CountedText:
    """A text whose number of tokens stays known while it is edited."""

    def __init__(self, text: str, enc: Encoder, leaf: int = LEAF):
        self._encoder, self._leaf = enc, leaf
        self.encoded = 0  # characters encoded so far
        self._build(self._leaves_of(text))

    def _leaves_of(self, text: str) -> list[Leaf]:
        self.encoded += len(text)
        return leaves_of(text, self._encoder, self._leaf)

    def _joins(self, left: Leaf, right: Leaf) -> bool:
        """Whether the tokens of two leaves side by side are those of their texts in one."""
        if right.text[0] in _BLANKS and not left.text[-1].isspace():
            return True
        return holds(left.text, right.text, self._encoder.marks) and self._encoder.stay_apart(left.last, right.first)

    def _build(self, leaves: list[Leaf]) -> None:
        self._size = 1 << max(0, len(leaves) - 1).bit_length()
        self._leaves: list[list[Leaf]] = [[x] for x in leaves] + [[] for _ in range(self._size - len(leaves))]
        self._sums = [(0, 0)] * (2 * self._size)
        for i in range(self._size):
            self._sums[self._size + i] = self._sum(i)
        for i in range(self._size - 1, 0, -1):
            self._sums[i] = self._add(i)

    def _sum(self, i: int) -> tuple[int, int]:
        return sum(len(x.text) for x in self._leaves[i]), sum(x.n for x in self._leaves[i])

    def _add(self, i: int) -> tuple[int, int]:
        (a, b), (c, d) = self._sums[2 * i], self._sums[2 * i + 1]
        return a + c, b + d

    def _set(self, i: int, leaves: list[Leaf]) -> None:
        self._leaves[i] = leaves
        i += self._size
        self._sums[i] = self._sum(i - self._size)
        while i > 1:
            i //= 2
            self._sums[i] = self._add(i)

    @property
    def n_chars(self) -> int:
        return self._sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self._sums[1][1]

    @property
    def text(self) -> str:
        return "".join(x.text for slot in self._leaves for x in slot)

    def _slot(self, at: int) -> tuple[int, int]:
        """The slot that holds the character at `at`, and where that slot begins."""
        i, begin = 1, 0
        while i < self._size:
            left = self._sums[2 * i][0]
            if at < begin + left:
                i = 2 * i
            else:
                i, begin = 2 * i + 1, begin + left
        return i - self._size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace [start, end) by `new`; places beyond the text are moved to its end."""
        n = self.n_chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        # The leaves around these places are encoded again; they move outward until the cuts beside the leaves hold,
        # by twice as much each time, so that a run whose tokens all shift is encoded a few times at most.
        low, high, more = max(0, start - 1), min(n, end + 1), 1
        while True:
            first, begin = self._slot(low)
            last, stop = self._slot(max(low, high - 1)) if n else (first, begin)
            stop += self._sums[self._size + last][0]
            old = [x for slot in self._leaves[first : last + 1] for x in slot]
            head, tail = 0, len(old)
            while head < tail and begin + len(old[head].text) <= low:
                begin += len(old[head].text)
                head += 1
            while tail > head and stop - len(old[tail - 1].text) >= high:
                stop -= len(old[tail - 1].text)
                tail -= 1
            region = "".join(x.text for x in old[head:tail])
            changed = region[: start - begin] + new + region[end - begin :]
            fresh = self._leaves_of(changed) if changed else []
            row = [*self._beside(old, head - 1, first, -1), *fresh, *self._beside(old, tail, last, 1)]
            left_ok = begin == 0 or len(row) < 2 or self._joins(row[0], row[1])
            right_ok = stop == n or len(row) < 2 or self._joins(row[-2], row[-1])
            if left_ok and right_ok:
                break
            low, high = low if left_ok else max(0, begin - more), high if right_ok else min(n, stop + more)
            more = max(2 * more, self._leaf)
        for i in range(first + 1, last + 1):
            self._set(i, [])
        self._set(first, old[:head] + fresh + old[tail:])
        if len(self._leaves[first]) > 16:  # leaves gather in one slot: lay them out again, at no encoding
            self._build([x for slot in self._leaves for x in slot if x.text] or [Leaf("", 0, -1, -1)])

    def _beside(self, old: list[Leaf], at: int, slot: int, step: int) -> list[Leaf]:
        """The leaf at `at` of `old`, or else the nearest one before (step -1) or behind `slot`; none at the text's ends."""
        if 0 <= at < len(old):
            return [old[at]]
        slot += step
        while 0 <= slot < self._size:
            if found := [x for x in self._leaves[slot] if x.text]:
                return [found[0 if step > 0 else -1]]
            slot += step
        return []


def edited_counts(rows: DataFrame) -> DataFrame:
    """Counts before and after edits, for `rows` of doc_id, text and edits.

    `edits` is an array of structs (start, end, replacement) in the order they
    apply, each to the text that the ones before left; null means none. Gives
    doc_id, n_chars, n_tokens, edited_chars, edited_tokens and reencoded_chars
    for each row; null texts count as empty, repeated rows repeat.
    """
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            out = []
            for doc_id, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                counted = CountedText(text.as_py() or "", enc)
                before = (counted.n_chars, counted.n_tokens, counted.encoded)
                for e in edits or []:
                    counted.edit(e["start"], e["end"], e["replacement"] or "")
                out.append((doc_id, *before[:2], counted.n_chars, counted.n_tokens, counted.encoded - before[2]))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    schema = ", ".join(f"{n} long" for n in names)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("edits").cast("array<struct<start:long,end:long,replacement:string>>").alias("edits"),
    ).mapInArrow(each, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with the rows of `edits` (doc_id, nth, start, end, replacement) gathered for each document."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "start", "end", "replacement"))).alias("e"))
    plain = F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement")))
    return docs.select("doc_id", "text").join(listed.select("doc_id", plain.alias("edits")), "doc_id", "left")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document before and after three edits: 16 characters go after a
    quarter of it, a word comes in at its middle, and its last 32 characters are replaced."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("replacement"))
    half = F.floor(n / 2)
    edits = F.array(
        edit(F.floor(n / 4), F.floor(n / 4) + 16, ""),
        edit(half, half, " [edited] "),
        edit(F.greatest(F.lit(0), n - 32), n + 32, "The end."),
    )
    return edited_counts(documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits")))
