"""Sharding by histogram sort: probe the key space, count exact bytes below the probes, refine, exchange once.

Every row gets a 64-bit key whose upper half comes from its text and whose lower half from the whole row, so that equal
texts are neighbours and yet can be split where one text alone is larger than a shard. Key space is cut into cells by
leading key bits. Each round counts the exact bytes and rows of the cells under refinement in one aggregation; a cell is
cut into finer ones while it holds a splitter and more bytes than the tolerance, or more rows than one task should sort.
Splitters then lie on cell edges, whole cells go to shards, and rows move in a single exchange keyed by cell. A row's slot
is the number of rows in the shard's earlier cells plus its rank in its own cell.

Memory: the driver holds the cells, at most 4096 + 256 for each refined one; at most about ``shards`` + 512 are refined
in a round. No task sees more than one cell.

Defined results: null and empty texts count no bytes; very long texts count whole and only their hash is a key; rows alike in
every column are interchangeable and share a shard; an empty table gives an empty table; columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from riskframe.llm._shared import fresh, staged

FIRST_BITS, NEXT_BITS, KEY_BITS = 12, 8, 64


@dataclass
class Cell:
    level: int
    prefix: int
    n_bytes: int
    n_rows: int

    def start(self) -> int:
        """First key of the cell, as an unsigned number."""
        return self.prefix << (KEY_BITS - bits(self.level))


def bits(level: int) -> int:
    return min(KEY_BITS, FIRST_BITS + NEXT_BITS * level)


def prefix(key: Column, level: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits(level)) if bits(level) < KEY_BITS else key


def row_key(text: Column, row: list[Column]) -> Column:
    """Upper 32 bits from the text, lower 32 from the row."""
    high = F.xxhash64(F.lit("text"), text).bitwiseAND(F.lit(-(1 << 32)))
    return high.bitwiseOR(F.xxhash64(F.lit("row"), *row).bitwiseAND(F.lit((1 << 32) - 1)))


def counted(keys: DataFrame, level: int, parents: list[int] | None) -> list[Cell]:
    """Exact bytes and rows of the cells at a level, in the given parents only."""
    if parents is not None:
        rows = keys.sparkSession.createDataFrame([(p,) for p in parents], "parent long")
        keys = keys.withColumn("parent", prefix(F.col("key"), level - 1)).join(F.broadcast(rows), "parent")
    found = keys.groupBy(prefix(F.col("key"), level).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return [Cell(level, r.cell, r.b, r.n) for r in found.collect()]


def unsigned(cell: Cell) -> int:
    return cell.start() % (1 << KEY_BITS)


def find_cells(keys: DataFrame, shards: int, tolerance: float, sort_rows: int) -> list[Cell]:
    """Cells in key order, fine enough to cut at: the histogram rounds."""
    cells = sorted(counted(keys, 0, None), key=unsigned)
    total = sum(c.n_bytes for c in cells)
    while True:
        below, coarse = 0, []
        for c in cells:
            cut = total and below * shards // total != (below + c.n_bytes) * shards // total
            if bits(c.level) < KEY_BITS and c.n_rows > 1 and (cut and c.n_bytes * shards > tolerance * total or c.n_rows > sort_rows):
                coarse.append(c)
            below += c.n_bytes
        if not coarse:
            return cells
        gone, fine = {id(c) for c in coarse}, []
        for level in sorted({c.level for c in coarse}):
            fine += counted(keys, level + 1, [c.prefix for c in coarse if c.level == level])
        cells = sorted([c for c in cells if id(c) not in gone] + fine, key=unsigned)


def placed(cells: list[Cell], shards: int) -> list[tuple[int, int, int, int]]:
    """(level, prefix, shard, slots before) for each cell: a cell goes where its middle byte falls."""
    total, below, before, out = sum(c.n_bytes for c in cells), 0, [0] * shards, []
    for c in cells:
        shard = min(shards - 1, (2 * below + c.n_bytes) * shards // (2 * total)) if total else 0
        out.append((c.level, c.prefix, shard, before[shard]))
        before[shard] += c.n_rows
        below += c.n_bytes
    return out


def shard_by_bytes(
    df: DataFrame, shards: int, text_col: str = "text", tolerance: float = 0.002, overhead: int = 16, cells_at_most: int = 512, sort_rows: int = 20_000
) -> DataFrame:
    """df with ``_size`` (UTF-8 bytes of the text plus overhead), ``_shard`` and ``_slot``, contiguous in key order.

    Where df has columns of these names, those added get underscores after theirs.

    tolerance: share of a shard by which a splitter may miss its place. Cells of more than sort_rows rows, and of more than
    1/cells_at_most of all rows, are refined for sorting as well.
    """
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index(text_col)}")
    whole = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind]
    keyed = rows.select(
        *rows.columns,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        row_key(text, whole).alias("key"),
        F.xxhash64(F.lit("tie"), *whole).alias("tie"),
    )
    keys = staged(keyed.select("key", "size"), "keys")
    cells = find_cells(keys, shards, tolerance, max(sort_rows, keys.count() // cells_at_most))
    table = placed(cells, shards)
    spark = df.sparkSession
    for level in sorted({t[0] for t in table}) or [0]:
        own = spark.createDataFrame([(p, [s, b, i]) for i, (at, p, s, b) in enumerate(table) if at == level], f"p{level} long, at{level} array<long>")
        keyed = keyed.withColumn(f"p{level}", prefix(F.col("key"), level)).join(F.broadcast(own), f"p{level}", "left")
    at = F.coalesce(*[F.col(f"at{level}") for level in sorted({t[0] for t in table}) or [0]])
    keyed = keyed.select(*rows.columns, "size", "key", "tie", at.alias("at"))
    order = W.partitionBy(F.col("at")[2]).orderBy("key", "tie")
    size, shard, slot = fresh(names, "_size", "_shard", "_slot")
    return keyed.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)],
        F.col("size").alias(size),
        F.col("at")[0].cast("int").alias(shard),
        (F.col("at")[1] + F.row_number().over(order) - 1).alias(slot),
    )
