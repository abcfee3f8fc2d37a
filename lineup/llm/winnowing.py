"""Operator 11: document fingerprints by winnowing, in DataFrame functions only.

A text's units are its runs ``[^\\x20\\x09-\\x0D]{1,16}`` (words; longer runs are cut every 16 code points, so text without spaces has units, too). A
unit's value is its CRC-32, and a gram of ``K`` units has the rolling polynomial hash ``sum(value[j] * BASE^(K-1-j)) mod 2^31-1``. The sums of
neighbouring grams are shared: runs of 2 units are built from single ones, runs of 4 from runs of 2. Of each window of ``W`` grams the smallest
hash is kept, of equal ones the rightmost; windows' minima are shared in the same way. A kept hash carries its place, packed as
``hash * 2^31 + (2^31 - 1 - place)``, so that a plain minimum of the packed values breaks ties to the right.

Guarantee: two texts that share ``W + K - 1`` consecutive units (11) share a kept hash at the same place of that passage; shared runs under ``K`` units are
never seen. Texts of fewer than ``K`` units are one gram; with fewer than ``W`` grams there is one window. Long texts are taken in blocks of
``BLOCK`` windows that overlap by a window, which keeps exactly the same hashes in bounded memory.

``likeness`` is the Jaccard share of two texts' kept hashes (1 for two empty ones). Equal texts have equal fingerprints.

``successors`` gives every document the text of the next one in descending ``doc_id`` without a window over all rows: cells of ids, cut at quantiles,
are ordered on their own, and the largest id of each cell is a guest at the end of the next cell; the largest of all is the guest of the smallest cell.

Defined results: null texts are empty ones (fingerprint ``""``); of several rows with one ``doc_id`` the smaller text comes first, equal rows follow each
other; rows with a null ``doc_id`` have no place in the order: no next document (its text counts as empty, ``near_next`` is null); a single row is its
own next document; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineup.llm.common import documents

K, W = 4, 8
PRIME, BASE = (1 << 31) - 1, 1103515245
LAST = (1 << 31) - 1
#: Windows of a block of a long text.
BLOCK = 4096
UNIT = r"[^\x20\x09-\x0D]{1,16}"
#: Rows of a cell of ids, at least and at most so many cells.
CELL, CELLS = 20_000, (1_000, 100_000)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``step`` places on."""
    return _let(values, lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), join))


def _grams(values: Column) -> Column:
    """Hashes of the runs of ``K`` values; of fewer values one hash of all."""

    def shifted(step: int):
        return lambda a, b: (a * pow(BASE, step, PRIME) + b) % PRIME

    rolled, step = values, 1
    while step < K:  # K is a power of two
        rolled = _joined(rolled, step, shifted(step))
        step *= 2
    whole = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: (a * BASE + x) % PRIME)
    return F.when(F.size(values) >= K, F.slice(rolled, 1, F.greatest(F.size(values) - K + 1, F.lit(1)))).when(F.size(values) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column) -> Column:
    """Packed smallest hash, the rightmost of equal ones, of every window of ``W`` grams; of fewer grams one window."""
    least, step = F.transform(grams, lambda h, i: h * F.lit(LAST + 1) + (F.lit(LAST) - i)), 1
    while step < W:  # W is a power of two
        least = _joined(least, step, lambda a, b: F.least(a, b))  # skips the missing values behind the end
        step *= 2
    return F.slice(least, 1, F.greatest(F.size(grams) - W + 1, F.lit(1)))


def _packed(text: Column) -> Column:
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))

    def block(all_units: Column, start: Column) -> Column:
        own = F.transform(F.slice(all_units, start + 1, BLOCK + W + K - 2), lambda u: F.crc32(u.cast("binary")) % PRIME)
        minima = _let(_let(own, _grams), _minima)
        return F.transform(F.array_distinct(minima), lambda v: v - start)

    def blocks(u: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(u) - (W + K - 1), F.lit(0)), F.lit(BLOCK))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: block(u, s))))

    return _let(units, blocks)


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def fingerprint(text: Column) -> Column:
    """The kept hashes of a text in order, with their places: ``array<struct<place: bigint, hash: bigint>>``."""
    return F.transform(_packed(text), lambda v: F.struct((F.lit(LAST) - v.bitwiseAND(F.lit(LAST))).alias("place"), _hash(v).alias("hash")))


def matches(a: Column, b: Column) -> Column:
    """Places of equal kept hashes of two fingerprints, ``array<struct<a, b, hash>>``: every passage of ``W + K - 1`` shared units has one."""
    places = _let(b, lambda other: F.transform(a, lambda x: F.transform(F.filter(other, lambda y: y["hash"] == x["hash"]), lambda y: F.struct(x["place"].alias("a"), y["place"].alias("b"), x["hash"].alias("hash")))))
    return F.flatten(places)


def _likeness(a: Column, b: Column) -> Column:
    """Jaccard share of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard share of the kept hashes of two results of ``fingerprint``."""
    return _likeness(F.array_distinct(a["hash"]), F.array_distinct(b["hash"]))


def _cuts(df: DataFrame) -> list[int]:
    """The largest id of every cell; at most ``CELLS[1]`` numbers. Approximate quantiles deal the ids, their cells' true maxima are taken."""
    ids = df.select("doc_id").where(F.col("doc_id").isNotNull())
    cells = min(CELLS[1], max(CELLS[0], ids.count() // CELL))
    near = ids.agg(F.percentile_approx("doc_id", [k / cells for k in range(1, cells + 1)], F.lit(10 * cells)).alias("q")).first()["q"]
    return sorted(r["top"] for r in ids.groupBy(_cell(F.col("doc_id"), sorted(set(near or [])))).agg(F.max("doc_id").alias("top")).collect())


def _cell(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are smaller; a coarse look-up, then a fine one."""
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda values: F.lit(list(values)).cast("array<bigint>") if values else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(longs(cuts[step - 1 :: step]), lambda c: c < doc_id)) * step
    return coarse + F.size(F.filter(F.slice(longs(cuts), coarse + 1, step), lambda c: c < doc_id))


def successors(df: DataFrame) -> tuple[DataFrame, Window]:
    """``doc_id, text, cell, guest`` and the window in which the next row is the next document; guests are to be dropped after its use."""
    cuts = _cuts(df)
    top = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    src = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("own", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(CELLS[0])).cast("int")).otherwise(_cell(F.col("doc_id"), cuts)))
    place = lambda cell, guest, behind: F.struct(cell.alias("cell"), F.lit(guest).alias("guest"), F.lit(behind).alias("behind"))
    own = place(F.col("own"), False, False)
    following = F.when(F.col("own") == len(cuts) - 1, place(F.lit(0), True, True)).otherwise(place(F.col("own") + 1, True, False))
    src = src.withColumn("place", F.explode(F.when(F.get(top, F.col("own")) == F.col("doc_id"), F.array(own, following)).otherwise(F.array(own))))
    window = Window.partitionBy("cell").orderBy(F.asc("behind"), F.desc("doc_id"), F.asc("text"))
    return src.select("doc_id", "text", "place.cell", "place.guest", "place.behind"), window


def fingerprints(df: DataFrame) -> DataFrame:
    """Per row the packed hashes of its text, of its edited text and the two likenesses; the edited text ends with the next document's beginning."""
    src, window = successors(df)
    placed = F.col("doc_id").isNotNull()
    out = src.withColumns({"packed": _packed(F.col("text")), "n_chars": F.length("text").cast("bigint")})
    out = out.withColumns({"next_text": F.when(placed, F.lead("text").over(window)), "next_packed": F.when(placed, F.lead("packed").over(window))}).where(~F.col("guest"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - tail), F.left(F.coalesce("next_text", F.lit("")), tail))
    out = out.select("doc_id", "n_chars", "packed", "next_packed", edited.alias("edited"))
    out = out.withColumn("edited_packed", _packed(F.col("edited")))
    kept = {name: F.array_distinct(F.transform(name, _hash)) for name in ("packed", "edited_packed", "next_packed")}
    out = out.withColumns({f"{name}_set": of for name, of in kept.items()})
    return out.withColumns({"near_edited": _likeness(F.col("packed_set"), F.col("edited_packed_set")), "near_next": _likeness(F.col("packed_set"), F.col("next_packed_set"))})


def _text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda v: F.lower(F.lpad(F.hex(_hash(v)), 8, "0"))), " ")


def query(spark, sf_dir):
    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), _text(F.col("packed")).alias("fingerprint"), _text(F.col("edited_packed")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


_POWERS = [pow(BASE, j, PRIME) for j in range(K)]
_GRAM = " + ".join(f"(v[i + {j}] * {_POWERS[K - 1 - j]} % {PRIME})" for j in range(K))
#: The same without shared sums and minima: a polynomial for each gram, a minimum for each window, CRC-32 a distinct unit at a time.
SQL = rf"""
WITH polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER (ORDER BY doc_id DESC, coalesce(text, '')) AS row, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT d.row, d.doc_id, d.text, left(d.text, length(d.text) - length(d.text) // 3) || left(n.text, length(d.text) // 3) AS edited, n.row AS next_row
    FROM d JOIN d n ON n.row = d.row % (SELECT count(*) FROM d) + 1),
texts AS (SELECT row, 'text' AS kind, text FROM e UNION ALL SELECT row, 'edited', edited FROM e),
units AS (SELECT row, kind, unnest(u) AS unit, generate_subscripts(u, 1) AS place FROM (SELECT row, kind, regexp_extract_all(text, '{UNIT}') AS u FROM texts)),
hashed AS (SELECT unit, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(unit)), lambda j: ('0x' || substr(hex(unit), (2 * j + 1)::INT, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {PRIME} AS value FROM (SELECT DISTINCT unit FROM units), polynomial),
valued AS (SELECT row, kind, list(value ORDER BY place) AS v FROM units JOIN hashed USING (unit) GROUP BY row, kind),
grams AS (SELECT row, kind, CASE WHEN len(v) < {K} THEN [list_reduce(list_prepend(0::BIGINT, v), lambda a, x: (a * {BASE} + x) % {PRIME})]
    ELSE list_transform(range(1, len(v) - {K - 2}), lambda i: ({_GRAM}) % {PRIME}) END AS g FROM valued),
least AS (SELECT row, kind, list_transform(range(1, greatest(len(g) - {W - 1}, 1) + 1), lambda i:
    list_min(list_transform(range(i, least(i + {W - 1}, len(g)) + 1), lambda j: g[j] * {LAST + 1} + {LAST + 1} - j))) AS m FROM grams),
kept AS (SELECT row, kind, list_transform(list_sort(list_transform(list_distinct(m), lambda x: ({LAST} - x % {LAST + 1}) * {LAST + 1} + x // {LAST + 1})), lambda x: x % {LAST + 1}) AS h FROM least),
f AS (SELECT texts.row, texts.kind, coalesce(h, []) AS h, coalesce(array_to_string(list_transform(h, lambda x: lpad(lower(hex(x)), 8, '0')), ' '), '') AS written FROM texts LEFT JOIN kept USING (row, kind))
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.written AS fingerprint, b.written AS edited_fingerprint,
  CASE WHEN len(list_distinct(list_concat(a.h, b.h))) = 0 THEN 1.0 ELSE len(list_intersect(a.h, b.h))::DOUBLE / len(list_distinct(list_concat(a.h, b.h))) END::DOUBLE AS near_edited,
  CASE WHEN len(list_distinct(list_concat(a.h, c.h))) = 0 THEN 1.0 ELSE len(list_intersect(a.h, c.h))::DOUBLE / len(list_distinct(list_concat(a.h, c.h))) END::DOUBLE AS near_next
FROM e JOIN f a ON a.row = e.row AND a.kind = 'text' JOIN f b ON b.row = e.row AND b.kind = 'edited' JOIN f c ON c.row = e.next_row AND c.kind = 'text'
"""
