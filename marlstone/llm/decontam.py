"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
benchmark texts, run once over each text's words, with hits mapped back to
offsets in the original text.

Normalisation lower-cases A-Z and takes maximal runs of letters, digits and
non-ASCII characters as words. An item gives one pattern for every WINDOW
consecutive words, or its whole word sequence if it is shorter. The automaton
reads the words with a space around each, so a match is always of whole words.

Defined cases: a null or empty text has no words and no hit; an item with a
null id or without words has no pattern; items with equal texts are each
reported; repeated rows are treated alike; other columns are ignored; with no
items nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: An automaton holds this much benchmark text at most, some 100 MB; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 1 << 18
#: A worker holds this many automata at once; with more blocks, each HELD_BYTES of rows meet them in turn.
AUTOMATA = 2
HELD_BYTES = 1 << 25

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = "doc_id {}, n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def spaced(own: list[bytes] | tuple[bytes, ...]) -> str:
    return (b" " + b" ".join(own) + b" ").decode("latin-1")


class Automaton:
    """Patterns of whole words; find() gives (first word, past last, item ids)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.machine = ahocorasick.Automaton()
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            own = tuple(words(text))
            for k in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(own[k : k + window], set()).add(item)
        for pattern, who in owners.items():
            self.machine.add_word(spaced(pattern), (len(pattern), sorted(who)))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def find(self, own: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        if not self.any or not own:
            return
        ends = None
        for last, (size, who) in self.machine.iter(spaced(own)):
            if ends is None:  # offset of the space after each word
                ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            end = int(np.searchsorted(ends, last)) + 1
            yield end - size, end, who


_BUILT: dict[str, list[Automaton]] = {}


def _machines(key: str, blocks, window: int) -> list[Automaton]:
    """The automata of some blocks; one worker keeps the last ones for its many tasks."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Automaton(b.value, window) for b in blocks]
    return _BUILT[key]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(batches: Iterator[pa.RecordBatch], key: str, blocks, window: int) -> Iterator[pa.RecordBatch]:
    """Every row's hits in all blocks, united within the row."""
    # automata that don't fit together are built in turn for each list of batches
    for held in _held(batches, HELD_BYTES if len(blocks) > AUTOMATA else 0):
        counts = [[0] * b.num_rows for b in held]
        flags: list[dict[int, bytearray]] = [{} for _ in held]
        who: list[dict[int, set[str]]] = [{} for _ in held]
        for lo in range(0, max(1, len(blocks)), AUTOMATA):
            machines = _machines(f"{key}-{lo}", blocks[lo : lo + AUTOMATA], window)
            for n, batch in enumerate(held):
                for k, text in enumerate(batch.column("text")):
                    own = words(text.as_py())
                    counts[n][k] = len(own)
                    for machine in machines:
                        for start, end, names in machine.find(own):
                            if k not in flags[n]:
                                flags[n][k], who[n][k] = bytearray(len(own)), set()
                            flags[n][k][start:end] = b"\1" * (end - start)
                            who[n][k].update(names)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for n, batch in enumerate(held):
            hit = [np.flatnonzero(np.frombuffer(flags[n][k], np.uint8)).tolist() if k in flags[n] else [] for k in range(batch.num_rows)]
            found = [sorted(who[n].get(k, ())) for k in range(batch.num_rows)]
            spans = [_original(batch.column("text")[k].as_py(), at) if at else [] for k, at in enumerate(hit)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts[n], pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(spans, kind)],
                names=["doc_id", "n_words", "hit_words", "items", "spans"],
            )


def _original(text: str, at: list[int]) -> list[dict[str, int]]:
    """Maximal spans of hit words, as code points of the original text."""
    where = [m.span() for m in _WORD.finditer(text)]
    out: list[dict[str, int]] = []
    last = -2
    for k in at:
        if k == last + 1:
            out[-1]["end"] = where[k][1]
        else:
            out.append({"start": where[k][0], "end": where[k][1]})
        last = k
    return out


def _drop(batches: Iterator[pa.RecordBatch], key: str, items, window: int) -> Iterator[pa.RecordBatch]:
    (machine,) = _machines(key, [items], window)
    for batch in batches:
        yield batch.filter(pa.array([next(machine.find(words(t.as_py())), None) is None for t in batch.column("text")], pa.bool_()))


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (id, text) rows in blocks of about block_bytes of text, one after another on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        yield [tuple(r) for r in part.collect()]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for block in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(partial(_drop, key=uuid.uuid4().hex, items=shared, window=window), fields)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, hit_words (word numbers), items, spans.

    The benchmark goes to the executors in blocks of block_bytes of text. All
    blocks are scanned in one pass without a shuffle, and a row's hits are
    united in the row, so ids may repeat or be null.
    """
    schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())
    blocks = [docs.sparkSession.sparkContext.broadcast(block) for block in blocks_of(benchmark, block_bytes)]
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, key=uuid.uuid4().hex, blocks=blocks, window=window), schema)
