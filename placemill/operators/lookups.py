"""Tables beside an index that answer a question from a few row groups: terms within one edit, whole names, shapes by the cells they touch, the best of a list."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.functions import geo, text

#: Fields whose words are also met with one edit.
EDITED = ("name", "search_names")
#: Bytes up to which a term has a key for each byte that may be missing; from there on it has keys of its halves.
SHORT = 48
#: Deepest zoom of the cells of shapes.
ZOOM = 10


@dataclass(frozen=True)
class Lookups:
    """What an index has beside features, postings and statistics. Searches do without what isn't there."""

    neighbours: DataFrame | None = None
    names: DataFrame | None = None
    shapes: DataFrame | None = None
    ranked: DataFrame | None = None
    blocks: DataFrame | None = None


# --- terms within one edit ---------------------------------------------------------------------------------------


def edit_keys(term: Column) -> Column:
    """Hashes such that two terms of byte edit distance at most one share one.

    A short term has itself and itself without each of its bytes: two terms an edit apart share what is left without the edited
    byte. A long one has its first and last halves, one of which the edit leaves alone; their length is half of the shorter term's, which
    is the term's own or one less. A term of SHORT bytes has both, so that it meets either kind.
    """
    b, n = text.as_bytes(term), F.octet_length(term)
    # the bytes are characters here, so a place is a byte
    lacking = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 1, n))))
    halves = F.flatten(F.transform(F.array(F.floor((n - 1) / 2), F.floor(n / 2)), lambda h: F.array(F.xxhash64(F.lit("first"), F.substring(b, F.lit(1), h.cast("int"))), F.xxhash64(F.lit("last"), F.substring(b, (n - h + 1).cast("int"), h.cast("int"))))))
    none = F.array().cast("array<bigint>")
    short = F.when((n >= 1) & (n <= SHORT), F.concat(F.array(F.xxhash64(b)), lacking)).otherwise(none)
    return F.array_distinct(F.concat(short, F.when(n >= SHORT, halves).otherwise(none)))


def neighbours(statistics: DataFrame, fields: tuple[str, ...] = EDITED) -> DataFrame:
    """field, key, term, df, n_docs: a row for each edit key of a term."""
    own = statistics.filter(F.col("field").isin(*fields))
    return own.select("field", F.explode(edit_keys(F.col("term"))).alias("key"), "term", "df", "n_docs")


def edit_keys_now(term: str) -> set[int]:
    """edit_keys() of a word that the driver holds."""

    def key(*texts: str) -> int:
        seed = 42
        for t in texts:
            seed = xxhash.xxh64_intdigest(t.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    b = term.encode().decode("latin-1")
    n, out = len(b), set()
    if 1 <= n <= SHORT:
        out |= {key(b)} | {key(b[:i] + b[i + 1 :]) for i in range(n)}
    if n >= SHORT:
        for h in {(n - 1) // 2, n // 2}:
            out |= {key("first", b[:h]), key("last", b[n - h :])}
    return out


def near_terms(table: DataFrame, asked: DataFrame, words: Collection[tuple[str, str]]) -> DataFrame:
    """The asked rows (field, word, and others) with each term of the field within one edit of the word. words: their fields and words.

    The words' keys are few and become a list in the scan of the sorted table; no other terms are read.
    """
    keys = sorted({k for _, w in words for k in edit_keys_now(w)})
    if not keys:
        return table.select("field", "term", "df", "n_docs").limit(0).join(asked, "field")
    some = table.filter(F.col("field").isin(*sorted({f for f, _ in words})) & F.col("key").isin(*keys))
    keyed = asked.select("*", F.explode(edit_keys(F.col("word"))).alias("key"))
    met = some.join(F.broadcast(keyed), ["field", "key"]).filter(text.within_one_edit(F.col("term"), F.col("word")))
    return met.drop("key").distinct()


# --- whole names -------------------------------------------------------------------------------------------------


def whole_names(features: DataFrame) -> DataFrame:
    """folded, id: the name of each feature as a query is folded."""
    return features.select(text.fold(text.trim(F.col("name"))).alias("folded"), "id").filter("folded <> ''")


# --- cells of shapes ---------------------------------------------------------------------------------------------


def _cell(z: Column | int, x: Column, y: Column) -> Column:
    """One number for a cell of any zoom."""
    z = F.lit(z) if isinstance(z, int) else z
    return z.cast("long") * (1 << 2 * ZOOM + 2) + x * F.pow(F.lit(2.0), z).cast("long") + y


def cover(coords: Column, zoom: int = ZOOM) -> Column:
    """Cells that hold the shape's envelope: of the deepest zoom at which it is no wider and no higher than a cell, so at most four."""
    flat = lambda e, k: F.greatest(F.lit(-85.0), F.least(F.lit(85.0), e[k]))

    def of(e: Column) -> Column:
        (x1, y1), (x2, y2) = geo.tile_xy(e["min_lon"], flat(e, "max_lat"), zoom), geo.tile_xy(e["max_lon"], flat(e, "min_lat"), zoom)
        span = F.greatest(x2 - x1, y2 - y1)
        up = F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span.cast("double")))).cast("int")
        z = F.greatest(F.lit(0), F.lit(zoom) - up)
        down = lambda v: F.floor(v / F.pow(F.lit(2.0), F.lit(zoom) - z)).cast("int")
        return F.flatten(F.transform(F.sequence(down(x1), down(x2)), lambda x: F.transform(F.sequence(down(y1), down(y2)), lambda y: _cell(z, x, y))))

    return geo.let(geo.envelope(coords), of)


def by_cell(features: DataFrame) -> DataFrame:
    """The features once for each of their cells (`covers`, and `at`, the cell): to be sorted by it."""
    return features.withColumn("covers", cover(F.col("geom.coords"))).select("*", F.explode("covers").alias("at"))


def touching(shapes: DataFrame, window: geo.Window, most: int = 1000) -> DataFrame:
    """Features whose cells touch the window, each once: plain comparisons of the sorted cell, a list or a range for each zoom."""
    from placemill.operators.tiles import tile_range

    flat = geo.Window(max(window.min_lat, -85.0), min(window.max_lat, 85.0), max(window.min_lon, -180.0), min(window.max_lon, 180.0))
    if flat.min_lat > flat.max_lat or flat.min_lon > flat.max_lon:
        return shapes.filter(F.col("at") == F.element_at("covers", 1)).drop("covers", "at")

    def inside(at: Column) -> Column:
        out = F.lit(False)
        for z in range(ZOOM + 1):
            x1, y1, x2, y2 = tile_range(flat, z)
            number = lambda x, y, z=z: (z << 2 * ZOOM + 2) + (x << z) + y
            few = (x2 - x1 + 1) * (y2 - y1 + 1) <= most
            out = out | (at.isin(*[number(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)]) if few else at.between(number(x1, y1), number(x2, y2)))
        return out

    met = shapes.filter(inside(F.col("at")))
    # of a feature's cells in the window, the first stands for it
    return met.filter(F.col("at") == F.get(F.filter("covers", inside), 0)).drop("covers", "at")


# --- lists by impact ---------------------------------------------------------------------------------------------

#: Rows of a block of a list.
BLOCK = 1024
#: The list of all features, with one empty term.
EVERY = "every"


def impact(importance: Column) -> Column:
    """What a feature scores in a search without a text, exactly."""
    return F.round(F.lit(1.0) + F.greatest(importance, F.lit(0.0)) * 1000, 6)


def ranked(features: DataFrame, posts: DataFrame, fields: Collection[str]) -> DataFrame:
    """field, term, impact, id, cell, block: the lists of the fields, and that of all features, the greatest impact first, equal ones by id.

    Ranges over the whole order split a common term among tasks, so a list's blocks of BLOCK rows don't overlap; those at the ends of a range are shorter.
    """
    own = features.select("id", "cell", impact(F.col("importance")).alias("impact"))
    rows = posts.filter(F.col("field").isin(*fields)).select("field", "term", "id").join(own, "id")
    rows = rows.unionByName(own.select(F.lit(EVERY).alias("field"), F.lit("").alias("term"), "*"))
    order = ["field", "term", F.desc("impact"), "id"]
    placed = rows.select("field", "term", "impact", "id", "cell").repartitionByRange(*order).sortWithinPartitions(*order)
    # the rows of a partition are numbered in order from a multiple of 2^33, so a block is of one partition
    return placed.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))


def blocks(table: DataFrame) -> DataFrame:
    """field, term, n, greatest, least, last_id: the impacts of each block, and the last id of its least."""
    last = F.max(F.struct((-F.col("impact")).alias("below"), "id"))
    some = table.groupBy("field", "term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("greatest"), last.alias("last"))
    return some.select("field", "term", "n", "greatest", (-F.col("last.below")).alias("least"), F.col("last.id").alias("last_id"))


def listed(fields: Collection[tuple[str, tuple[str, ...]]]) -> Column:
    """Rows of any of the lists. The fields and terms by themselves as well: one skips folders, the other row groups."""
    any_ = reduce(Column.__or__, [(F.col("field") == f) & F.col("term").isin(*terms) for f, terms in fields])
    return F.col("field").isin(*sorted({f for f, _ in fields})) & F.col("term").isin(*sorted({t for _, terms in fields for t in terms})) & any_


def frontier(table: DataFrame, fields: Collection[tuple[str, tuple[str, ...]]], rows: int) -> tuple[float, str] | None:
    """(impact, id) down to which the lists hold at least so many rows in all, or as many as the blocks that were looked at; None: these are all."""
    most = 2 * rows // BLOCK + 32
    found = table.filter(listed(fields)).orderBy(F.desc("least"), "last_id").limit(most).collect()
    held = 0
    for b in found:
        held += b["n"]
        if held >= rows:
            return b["least"], b["last_id"]
    return (found[-1]["least"], found[-1]["last_id"]) if len(found) == most else None


def down_to(edge: tuple[float, str] | None) -> Column:
    """Rows up to the frontier; the first comparison reaches the scan's row groups."""
    if edge is None:
        return F.lit(True)
    return (F.col("impact") >= edge[0]) & ((F.col("impact") > edge[0]) | (F.col("id") <= edge[1]))
