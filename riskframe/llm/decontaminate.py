"""Benchmark decontamination with a distributed positional inverted index.

The index is built once and stored: documents are cut into blocks of bounded size, and each block becomes one row
with a posting list for each of its terms, the ascending positions of the term in the block's documents laid end to end.
Beside it lies the term dictionary: the number of postings of each term over all blocks. Terms are 64-bit hashes of words.

A phrase is searched in a block by taking the posting list of its rarest term, shifted by the term's offset, and
intersecting it with the shifted lists of the other terms from rare to common until none is left; all phrases go through these
steps together. A proximity match is a place of an item's rarest term that has the rarest of the terms beside it in the item
within a distance, in any order.

Blocks are searched where they lie, without a shuffle, so neither common terms nor repeated passages gather anywhere. Test
items go to the tasks in chunks of at most ``CHUNK_WORDS`` words (one item, if that is longer) as arrays of numbers, which bounds
what the driver holds and sends; each chunk is one pass over the index, and only what it found is stored.

Defined results: null texts have no words; items without words never occur; repeated rows each get their row; of equal
item ids all count as one in the list of items; an empty table, or no items, gives rows without hits; very long texts are whole
blocks of their own; other columns play no part; ids of documents that aren't whole numbers raise.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm._shared import known_columns, numbered, scratch_root, staged
from riskframe.llm.shingles import PIECE, span_hashes, utf8

#: Bytes to words: A-Z fold, 0-9, a-z and all beyond ASCII stay, everything else parts words.
TABLE = bytes(
    b + 32 if chr(b) in string.ascii_uppercase else b if b >= 0x80 or chr(b) in string.ascii_lowercase + string.digits else 0x20 for b in range(256)
)
CHUNK_WORDS = 100_000
#: Words of a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 18
#: Places that phrases are followed from at a time.
PLACES = 1 << 20
#: Terms of a proximity match.
NEAR_TERMS = 4
DISTANCE = 8
BLOCK = "doc_ids array<long>, digests array<long>, n_words array<int>, terms binary, ends binary, positions binary"
FOUND = "doc_id long, digest long, items array<string>, spans array<struct<start: long, stop: long>>, near array<struct<item: string, matches: long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
NEAR = pa.list_(pa.struct([("item", pa.string()), ("matches", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def terms_of(text: bytes) -> np.ndarray:
    """The hash of each word of a text."""
    words = words_of(text)
    pieces = [span_hashes(words[i : i + PIECE], 1) for i in range(0, len(words), PIECE)]
    return np.concatenate(pieces).view(np.int64) if pieces else np.empty(0, np.int64)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in ascending values, -1 where it isn't there."""
    if not len(values):
        return np.full(wanted.shape, -1)
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return np.where(values[at] == wanted, at, -1)


class Items:
    """Test items as terms, with their distinct windows: arrays only, of a size that the words of the items bound."""

    def __init__(self, rows: list[tuple[str, str | None]], width: int):
        self.width = width
        self.ids = sorted({str(i) for i, _ in rows if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        self.items, windows, owner = [], [np.empty((0, width + 1), np.int64)], [np.empty(0, np.int64)]
        for item, text in rows:
            terms = terms_of((text or "").encode("utf-8", "surrogatepass"))
            if item is None or not len(terms):
                continue
            self.items.append((number[str(item)], terms))
            n = max(1, len(terms) - width + 1)
            made = np.zeros((n, width + 1), np.int64)
            made[:, 0] = min(width, len(terms))
            made[:, 1 : 1 + min(width, len(terms))] = np.lib.stride_tricks.sliding_window_view(terms, min(width, len(terms)))
            windows.append(made)
            owner.append(np.full(n, number[str(item)]))
        distinct, inverse = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        self.lengths, self.windows = distinct[:, 0], distinct[:, 1:]
        #: Of window w the items are owners[first[w]:first[w + 1]].
        pairs = np.unique(np.stack((inverse.ravel(), np.concatenate(owner)), axis=1), axis=0)
        self.first, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]

    def terms(self) -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, np.int64), *[t for _, t in self.items]]))


@dataclass
class Search:
    """What a task needs: windows and proximity terms, each from the rarest term to the most common."""

    ids: list[str]
    terms: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    near_items: np.ndarray
    near_terms: np.ndarray
    near_n: np.ndarray
    distance: int


def by_rarity(items: Items, known: np.ndarray, postings: np.ndarray, distance: int) -> Search:
    """known: ascending posted terms, with their numbers of postings over all blocks."""

    def rarity(terms: np.ndarray) -> np.ndarray:
        at = among(known, terms)
        return np.where(at >= 0, postings[at] if len(postings) else 0, 0)

    inside = np.arange(items.width)[None, :] < items.lengths[:, None]
    n = np.where(inside, rarity(items.windows), np.iinfo(np.int64).max)
    live = np.flatnonzero((n > 0).all(axis=1))
    order = np.argsort(n[live], axis=1, kind="stable")
    counts = items.first[live + 1] - items.first[live]
    first = np.concatenate(([0], np.cumsum(counts)))
    owners = items.owners[np.repeat(items.first[live] - first[:-1], counts) + np.arange(first[-1])]
    near = []
    for item, terms in items.items:
        own = rarity(terms)
        posted = np.flatnonzero(own)
        if not len(posted):
            continue
        anchor = posted[np.argmin(own[posted])]
        beside = posted[(abs(posted - anchor) <= distance // 2) & (terms[posted] != terms[anchor])]
        _, once = np.unique(terms[beside], return_index=True)
        beside = beside[np.sort(once)]
        beside = beside[np.argsort(own[beside], kind="stable")][: NEAR_TERMS - 1]
        if len(beside):
            near.append((item, [terms[anchor], *terms[beside]]))
    near_terms = np.zeros((len(near), NEAR_TERMS), np.int64)
    for row, (_, terms) in zip(near_terms, near):
        row[: len(terms)] = terms
    return Search(
        items.ids, np.take_along_axis(items.windows[live], order, axis=1), order, items.lengths[live], first, owners,
        np.array([i for i, _ in near], np.int64), near_terms, np.array([len(t) for _, t in near], np.int64), distance,
    )


class Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.doc_ids, self.digests, self.n_words = row["doc_ids"], row["digests"], np.array(row["n_words"], np.int64)
        # One place is left free after each document, so that no phrase runs on into the next.
        self.firsts = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        self.terms, self.ends = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["ends"], np.int32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        #: Postings as ascending numbers: the term's place times stride, plus the position.
        self.stride = int(self.firsts[-1]) + 1
        self.postings = np.repeat(np.arange(len(self.terms)), self.ends - self.starts) * self.stride + self.positions

    def places(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in terms, position) of every posting of the terms (places in self.terms), about PLACES at a time."""
        sizes = self.ends[terms] - self.starts[terms]
        ends = np.cumsum(sizes)
        at = 0
        while at < len(terms):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
            n = sizes[at:to]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.arange(at, to), n), self.positions[np.repeat(self.starts[terms[at:to]], n) + within]
            at = to

    def phrases(self, search: Search) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every occurrence of a window."""
        at = among(self.terms, search.terms)
        inside = np.arange(search.terms.shape[1])[None, :] < search.lengths[:, None]
        live = np.flatnonzero(((at >= 0) | ~inside).all(axis=1))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for of, position in self.places(at[live, 0]):
            window = live[of]
            start = position - search.offsets[window, 0]
            fits = (start >= 0) & (start + search.lengths[window] < self.stride)
            window, start = window[fits], start[fits]
            for step in range(1, search.terms.shape[1]):
                more = search.lengths[window] > step
                if not more.any():
                    break
                wanted = at[window, step] * self.stride + start + search.offsets[window, step]
                keep = ~more | (among(self.postings, wanted) >= 0)
                window, start = window[keep], start[keep]
            found.append((window, start))
        return tuple(np.concatenate(x) for x in zip(*found))

    def near(self, search: Search) -> tuple[np.ndarray, np.ndarray]:
        """(row of search.near_items, position of its rarest term) of every proximity match."""
        at = among(self.terms, search.near_terms)
        inside = np.arange(NEAR_TERMS)[None, :] < search.near_n[:, None]
        live = np.flatnonzero(((at >= 0) | ~inside).all(axis=1))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for of, position in self.places(at[live, 0]):
            item, doc = live[of], self.documents(position)
            low, high = np.maximum(position - search.distance, self.firsts[doc]), np.minimum(position + search.distance, self.firsts[doc + 1] - 1)
            for step in range(1, NEAR_TERMS):
                base = at[item, step] * self.stride
                keep = (search.near_n[item] <= step) | (np.searchsorted(self.postings, base + low) < np.searchsorted(self.postings, base + high, side="right"))
                item, position, low, high = item[keep], position[keep], low[keep], high[keep]
            found.append((item, position))
        return tuple(np.concatenate(x) for x in zip(*found))

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, side="right") - 1


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text, digest) rows."""
    lists = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def block() -> pa.RecordBatch:
        counts = [len(t) for t in terms]
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        distinct, starts = np.unique(flat[order], return_index=True)
        positions = (order + np.repeat(np.arange(len(counts)), counts)[order]).astype(np.int32)
        ends = np.append(starts[1:], len(flat)).astype(np.int32) if len(flat) else np.empty(0, np.int32)
        row = [pa.array([x], kind) for x, kind in zip((ids, digests, counts), lists)]
        return pa.RecordBatch.from_arrays([*row, *[pa.array([x.tobytes()], pa.binary()) for x in (distinct, ends, positions)]], ["doc_ids", "digests", "n_words", "terms", "ends", "positions"])

    ids, digests, terms, size = [], [], [], 0
    for batch in batches:
        for i, text, digest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            found = terms_of(utf8(text))
            if ids and size + len(found) > BLOCK_WORDS:
                yield block()
                ids, digests, terms, size = [], [], [], 0
            ids.append(i)
            digests.append(digest)
            terms.append(found)
            size += len(found)
    if ids:
        yield block()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of each block's terms."""
    for batch in batches:
        for terms, ends in zip(batch.column(0), batch.column(1)):
            ends = np.frombuffer(ends.as_buffer(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_buffer(), np.int64)), pa.array(np.diff(ends, prepend=0).astype(np.int64))], ["term", "n"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [c.flatten() for c in batch.columns]
        yield pa.RecordBatch.from_arrays([flat[0], flat[1], flat[2].cast(pa.int64())], ["doc_id", "digest", "n_words"])


def _search(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what: Search = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})
                window, start = block.phrases(what)
                near, place = block.near(what)
                spans, items, close = {}, {}, {}
                edge = np.zeros(block.stride + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + what.lengths[window], -1)
                turns = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
                starts, stops = turns[::2], turns[1::2]
                doc = block.documents(starts)
                for d, x, y in zip(doc.tolist(), (starts - block.firsts[doc]).tolist(), (stops - block.firsts[doc]).tolist()):
                    spans.setdefault(d, []).append({"start": x, "stop": y})
                for d, w in np.unique(np.stack((block.documents(start), window), axis=1), axis=0).tolist():
                    items.setdefault(d, set()).update(what.owners[what.first[w] : what.first[w + 1]].tolist())
                pairs, matches = np.unique(np.stack((block.documents(place), what.near_items[near]), axis=1), axis=0, return_counts=True)
                for (d, item), n in zip(pairs.tolist(), matches.tolist()):
                    close.setdefault(d, []).append({"item": what.ids[item], "matches": n})
                docs = sorted(spans.keys() | close.keys())
                columns = [
                    pa.array([block.doc_ids[d] for d in docs], pa.int64()), pa.array([block.digests[d] for d in docs], pa.int64()),
                    pa.array([[what.ids[k] for k in sorted(items.get(d, ()))] for d in docs], pa.list_(pa.string())),
                    pa.array([spans.get(d, []) for d in docs], SPANS), pa.array([close.get(d, []) for d in docs], NEAR),
                ]
                yield from pa.table(columns, ["doc_id", "digest", "items", "spans", "near"]).to_batches(4096)

    return search


@dataclass
class Index:
    blocks: DataFrame
    #: (term, postings) of all terms of all blocks.
    dictionary: DataFrame

    def documents(self) -> DataFrame:
        """(doc_id, digest, n_words) of each document."""
        return self.blocks.select("doc_ids", "digests", "n_words").mapInArrow(_documents, "doc_id long, digest long, n_words long")


def build_index(docs: DataFrame) -> Index:
    """The stored index of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    blocks = staged(docs.mapInArrow(_build, BLOCK), "index")
    counts = blocks.select("terms", "ends").mapInArrow(_counts, "term long, n long")
    return Index(blocks, staged(counts.groupBy("term").agg(F.sum("n").alias("postings")), "dictionary"))


def search(index: Index, items: Items, distance: int = DISTANCE):
    """(found, broadcast): rows of FOUND for the documents with a phrase or a proximity match of items, and what was sent to find them."""
    spark = index.blocks.sparkSession
    wanted = spark.createDataFrame(pa.table({"wanted": items.terms()}), "wanted long")  # bounded by a chunk's words
    rows = index.dictionary.join(F.broadcast(wanted), F.col("term") == F.col("wanted")).select("term", "postings").toArrow()
    terms, postings = (rows.column(c).to_numpy().astype(np.int64) for c in ("term", "postings"))
    order = np.argsort(terms)
    sent = spark.sparkContext.broadcast(by_rarity(items, terms[order], postings[order], distance))
    return index.blocks.mapInArrow(_search(sent), FOUND), sent


def search_proximity(index: Index, items: Items, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, item_id, matches): places of an item's rarest term with the rarest of the terms beside it within distance words."""
    found, _ = search(index, items, distance)
    return found.select("doc_id", F.inline("near")).withColumnRenamed("item", "item_id")


def chunks(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[Items]:
    """The items, CHUNK_WORDS words or so at a time."""
    rows, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        rows.append(tuple(row))
        size += len(row[1] or "") // 4
        if size >= CHUNK_WORDS:
            yield Items(rows, width)
            rows, size = [], 0
    yield Items(rows, width)


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", distance: int = DISTANCE
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near, contaminated) for each row of docs; contaminated if n_hit is 5% of n_words or more.

    items: those with a window of width words in the document; near: those with a proximity match.
    """
    docs = known_columns(numbered(docs, id_col), doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = build_index(docs)
    path = f"{scratch_root(docs.sparkSession)}/found"
    for items in chunks(known_columns(benchmark, item_id=item_col, text=item_text_col), "item_id", "text", width):
        found, sent = search(index, items, distance)
        found.write.mode("append").parquet(path)
        sent.destroy()
    names = lambda lists: F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))
    # Runs of several chunks are united, so that no word counts twice.
    found = docs.sparkSession.read.schema(FOUND).parquet(path).groupBy(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")).agg(
        names("items").alias("items"), names("spans").alias("spans"), names(F.col("near.item")).alias("near")
    )
    total = F.expr("aggregate(spans, struct(0L as at, 0L as n), (a, s) -> struct(greatest(a.at, s.stop) as at, a.n + greatest(0L, s.stop - greatest(a.at, s.start)) as n), a -> a.n)")
    found = staged(found.select("k_id", "k_digest", total.alias("n_hit"), "items", "near"), "united")
    out = index.documents().join(found, F.expr("doc_id <=> k_id and digest = k_digest"), "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *[F.coalesce(c, none).alias(c) for c in ("items", "near")])
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
