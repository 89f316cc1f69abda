"""Spelling variants by pairs of trie nodes.

Words are numbered from the most frequent down. Their prefixes are the nodes of a trie, and their suffixes those of the trie of the
words read backwards. Both tries are numbered exactly, without strings of prefixes: words are sorted into ranges of about
``RANGE``, and a range numbers its nodes along its sorted words; nodes that reach over the border of ranges lie on the paths of
the ranges' first and last words, which alone go to the driver (two words for each ``RANGE`` words).

A word of length L then gives L pairs (prefix node, suffix node) that skip one position, and L + 1 pairs that skip none. Two words
of one length are near if they share a skipping pair, and a word is near one that is longer by one if its pair that skips none is
the other's skipping pair. A pair of nodes that skips one position is shared by as many words as there are letters at most,
so that no pair is a hot key. Of equal letters in a row only the first counts as inserted, so each near pair is found once.

A word's form is its most frequent near word (ties: first in code-point order), if that is at least ``twice`` as frequent; roots
are found by pointer jumping along forms, whose counts double at each step.

Defined results: null texts have no words; a null id takes part like any; repeated rows count each; words of any length; words that
have no near word have no form and are their own root; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm._shared import known_columns, staged
from riskframe.llm.shingles import LOWER, utf8

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a range.
RANGE = 1 << 16
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18


def slipped(word: str, doc: str, every: int) -> str:
    """The word, without one letter where the checksum of the document's id and the word is divisible by every."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def _counted(slip: int | None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = LETTERS.findall(utf8(text).translate(LOWER).decode("utf-8", "replace"))
                if slip is None or doc is None:
                    held.update(words)
                else:
                    head = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(words).items():
                        if zlib.crc32(word.encode(), head) % slip == 0:
                            word = slipped(word, doc, slip)
                        held[word] += n
                if len(held) > HELD:
                    yield passed_on()
        yield passed_on()

    return counted


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased; with slip, about one in so many (document, word) loses a letter."""
    docs = known_columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("string"), "text")
    return docs.mapInArrow(_counted(slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common(a: str, b: str) -> int:
    """How many letters two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def carried(ranges: list[tuple[int, str, str]]) -> dict[int, tuple[str, str, list[int]]]:
    """For each range (number, first word, last word): those words, and the numbers of the nodes that it takes over from ranges before."""
    out, last, path = {}, "", []
    for part, first, final in ranges:
        taken = path[: common(last, first)]
        out[part] = (first, final, taken)
        kept = taken[: common(first, final)]
        path = kept + [border(part, i) for i in range(len(kept) + 1, len(final) + 1)]
        last = final
    return out


def border(part: int, depth: int) -> int:
    """The number of a node on the path of a range's last word, which later ranges may share."""
    return part << 40 | depth


def numbered(words: list[str], part: int, first: str, final: str, taken: list[int]) -> Iterator[list[int]]:
    """The node of each prefix of sorted words, from the empty one (0) on."""
    fresh, last, path = (part << 40) + (1 << 39), "", [0]
    for word in words:
        path = path[: common(last, word) + 1]
        head, tail = min(common(first, word), len(taken)), common(word, final)
        for depth in range(len(path), len(word) + 1):
            if depth <= head:
                path.append(taken[depth - 1])
            elif depth <= tail:
                path.append(border(part, depth))
            else:
                fresh += 1
                path.append(fresh)
        last = word
        yield list(path)


def trie_nodes(words: DataFrame, spelt: Column) -> DataFrame:
    """(no, nodes) of (no, word): the numbers of the trie nodes that lead to each word as spelt."""
    spelt_words = words.select("no", spelt.alias("spelt"))
    ranges = max(1, -(-words.count() // RANGE))
    cut = staged(spelt_words.repartitionByRange(ranges, "spelt").withColumn("part", F.spark_partition_id() + 1), "cut")
    ends = cut.groupBy("part").agg(F.min("spelt").alias("first"), F.max("spelt").alias("last")).orderBy("part")
    borders = carried([tuple(r) for r in ends.collect()])

    def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        # Strings sort by code points here, and by UTF-8 bytes in Spark, which is the same order.
        pdf = pdf.sort_values("spelt", kind="stable")
        part = int(pdf.part.iloc[0])
        return pd.DataFrame({"no": pdf.no, "nodes": list(numbered(pdf.spelt.tolist(), part, *borders[part]))})

    return staged(cut.groupBy("part").applyInPandas(nodes, "no long, nodes array<long>"), "nodes")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) numbers of near words, both ways round, each pair once; words are (no, word)."""
    ahead = trie_nodes(words, F.col("word"))
    behind = trie_nodes(words, F.reverse("word")).select("no", F.col("nodes").alias("back"))
    both = staged(words.select("no", F.split("word", "").alias("letters")).join(ahead, "no").join(behind, "no"), "both")
    place = lambda skip, more="": F.expr(
        f"inline(transform(sequence(0, size(nodes) - {1 + skip}), at -> struct(nodes[at] as head, back[size(nodes) - {1 + skip} - at] as tail{more})))"
    )
    # Equal letters in a row are skipped at their first only.
    skipping = staged(both.select("no", place(1, ", at = 0 or letters[at - 1] <> letters[at] as leads")), "skipping")
    whole = both.select("no", place(0)).select(F.col("no").alias("b"), "head", "tail")
    mine, theirs = (skipping.select(F.col("no").alias(c), "head", "tail") for c in "ab")
    replaced = mine.join(theirs, ["head", "tail"]).filter("a <> b").select("a", "b")
    inserted = skipping.filter("leads").select(F.col("no").alias("a"), "head", "tail").join(whole, ["head", "tail"]).select("a", "b")
    return replaced.unionByName(inserted).unionByName(inserted.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(no, root) of (no, form): the last of the forms that follow each other, by pointer jumping."""
    step = staged(forms.select("no", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("no").alias("at"), F.col("root").alias("further"))
        step = staged(step.join(on, F.col("root") == F.col("at"), "left").select("no", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not step.filter("moved").limit(1).count():
            return step.select("no", "root")
        step = step.select("no", "root")


def spelling_forms(counts: DataFrame, least_length: int = 5, least_count: int = 3, twice: int = 2, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (word, n) rows that are long and frequent enough; words are distinct."""
    words = known_columns(counts, word=word_col, n=n_col).filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    words = staged(words, "words")
    # Numbers follow the order: a smaller one is a more frequent word.
    ranges = max(1, -(-words.count() // RANGE))
    order = [F.desc("n"), F.asc("word")]
    words = staged(words.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id()), "numbered")
    near = near_words(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min("b").alias("best"))
    best = words.select(F.col("no").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = staged(near.join(best, "best").join(words.withColumnRenamed("no", "a"), "a"), "found")
    is_form = F.col("form_n") >= twice * F.col("n")
    chains = roots(found.filter(is_form).select(F.col("a").alias("no"), F.col("best").alias("form")))
    names = words.select(F.col("no").alias("root"), F.col("word").alias("root_word"))
    chains = staged(chains.join(names, "root").select("no", "root_word"), "chains")
    near = found.select(F.col("a").alias("no"), "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    out = words.join(near, "no", "left").join(chains, "no", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
