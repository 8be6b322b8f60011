"""Queries of multi-position matching, its gates and explanation, partial matches and groups.

Stand-ins: a vector of 64 components is an item with four positions of 16: a 4 x 4 frame, a hash of signs, an int8 vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import kernels as K
from kindred.operators import building, matching, partials, snapshots
from kindred.operators.matching import MatchSettings
from kindred.plans.registry import query, read

_PX = "CAST(least(255, greatest(0, floor(128 + CAST(x AS DOUBLE) * 400))) AS INT)"


def snapshots_of(spark, d):
    """Items of the embeddings."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    part = lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.transform(F.slice(x, j * 16 + 1, 16), f))
    pixel = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128) + v * 400))).cast("int")
    small = lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(v * 254))).cast("int")
    signs = lambda e: F.aggregate(F.transform(e, lambda v, i: F.when(v < 0, F.call_function("shiftleft", F.expr("1L"), i)).otherwise(F.expr("0L"))), F.lit(0).cast("long"), lambda s, v: s + v)
    flat = lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.reverse(F.slice(e, r * 4 + 1, 4))))
    k = F.col("vec_id")
    rows = read(spark, d, "embeddings").select(
        k.alias("id"), (k % 5 == 0).alias("is_image"), F.when(k % 5 == 0, 0.0).otherwise((F.col("label") * 50 + k % 7).cast("double")).alias("duration"), part(pixel).alias("frames"), part(lambda v: v).alias("raw"),
        part(small).alias("emb"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (k + j) % 3 != 0).alias("emb_valid"),
        F.array(F.concat(F.lit("Top/"), (F.col("label") % 3).cast("string"))).alias("folders"), (k % 4).alias("size"), (F.col("label") % 2).cast("string").alias("dev"), (k % 3).cast("string").alias("ino"),
    )
    one = lambda c: F.when(F.col("is_image"), F.slice(c, 1, 1)).otherwise(F.col(c))
    rows = rows.withColumns({c: one(c) for c in ("frames", "emb", "emb_valid", "raw")})
    return rows.withColumns({"ph": F.transform("raw", signs), "ph_flip": F.transform("raw", lambda e: signs(flat(e)))}).drop("raw")


def _position_sql(j: int, what: str, mirror: bool = False) -> str:
    """A value of position j of a pair (x, y), the first mirrored or not."""
    at = f"{16 * j} + ((i - 1) // 4) * 4 + 4 - (i - 1) % 4" if mirror else f"{16 * j} + i"
    each = {"gray": f"abs(x.px[{at}] - y.px[{16 * j} + i])", "bits": f"CASE WHEN (x.e[{at}] < 0) <> (y.e[{16 * j} + i] < 0) THEN 1 ELSE 0 END", "dot": f"x.q[{at}] * y.q[{16 * j} + i]"}[what]
    total = f"list_sum(list_transform(range(1, 17), lambda i: {each}))"
    return {"gray": f"CAST({total} / 4096.0 AS FLOAT)", "bits": f"CAST({total} AS INT)", "dot": f"CAST(greatest(-1.0, least(1.0, {total} / 16129.0)) AS FLOAT)"}[what]


def _limit(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


def _classic_sql(s: MatchSettings, mirror: bool, p: str) -> tuple[list[str], list[str]]:
    """Columns of a pair's classic verdict in two steps: sums, then {p}ok, {p}diff and {p}alg."""
    gray = [_position_sql(j, "gray", mirror) for j in range(4)]
    bits = [_position_sql(j, "bits", mirror) for j in range(4)]
    sums = [f"{gray[0]} AS {p}g0", f"CAST({' + '.join(gray)} AS FLOAT) AS {p}g", *(f"{b} AS {p}b{j}" for j, b in enumerate(bits))]
    hits = " + ".join(f"CAST({p}b{j} <= {s.max_bits()} AS INT)" for j in range(4))
    total = " + ".join(f"{p}b{j}" for j in range(4))
    gm, gd = f"({p}g <= {_limit(s.gray_limit())})", f"CAST({p}g / 4 AS FLOAT)"
    pm, pd = f"({hits} >= {max(1, -(-4 * int(s.quorum * 100) // 100))})", f"CAST(({total}) / 256.0 AS FLOAT)"
    if s.combine:
        ok, diff = f"({gm} OR {pm})", f"CASE WHEN {gm} AND {pm} THEN least({gd}, {pd}) WHEN {gm} THEN {gd} WHEN {pm} THEN {pd} ELSE 1 END"
        alg = f"(CASE WHEN {gm} THEN 8 ELSE 0 END + CASE WHEN {pm} THEN 16 ELSE 0 END)"
    else:
        m, v = (pm, pd) if s.use_phash else (gm, gd)
        ok, diff, alg = m, f"CASE WHEN {m} THEN {v} ELSE 1 END", "0"
    im = f"({p}g0 <= {_limit(s.image_limit())})"
    return sums, [
        f"CASE WHEN image THEN {im} ELSE {ok} END AS {p}ok", f"CASE WHEN image THEN {p}g0 ELSE {diff} END AS {p}diff", f"CASE WHEN image THEN CASE WHEN {im} AND {str(s.combine).lower()} THEN 8 ELSE 0 END ELSE {alg} END AS {p}alg",
    ]


def _ai_sql() -> str:
    """Steps of the mean cosine over valid positions; images have one."""
    valid = [f"(x.v[{j + 1}] AND y.v[{j + 1}]" + (" AND NOT x.image)" if j else ")") for j in range(4)]
    total = "0"
    for j in range(4):
        total = f"CAST({total} + CASE WHEN {valid[j]} THEN {_position_sql(j, 'dot')} ELSE CAST(0 AS FLOAT) END AS FLOAT)"
    n = " + ".join(f"CAST({v} AS INT)" for v in valid)
    return f"CASE WHEN {n} >= CASE WHEN x.image THEN 1 ELSE 2 END THEN CAST(CAST({total} AS DOUBLE) / ({n}) AS FLOAT) ELSE -1 END AS ai"


_ITEMS = f"""s AS (SELECT vec_id AS id, vec_id % 5 = 0 AS image, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE CAST(label * 50 + vec_id % 7 AS DOUBLE) END AS duration, embedding AS e, list_transform(embedding, lambda x: {_PX}) AS px,
  list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 254, 0))) AS INT)) AS q, list_transform(range(0, 4), lambda j: (vec_id + j) % 3 <> 0) AS v,
  label % 3 AS folder, vec_id % 4 AS size, label % 2 AS dev, vec_id % 3 AS ino FROM embeddings)"""
_NEAR = "x.id < y.id AND x.image = y.image AND (x.image OR abs(x.duration - y.duration) <= least(x.duration * 0.2, y.duration * 0.2))"


def _verdicts(s: MatchSettings) -> str:
    """CTEs up to r: one row for each candidate pair, with match, difference and flags before the gates behind."""
    sums, normal = _classic_sql(s, False, "n")
    fsums, flipped = _classic_sql(s, True, "f") if s.flipped else ([], [])
    ai = _ai_sql() if s.use_ai else "CAST(-1 AS FLOAT) AS ai"
    by_ai = f"(NOT nok AND ai >= {_limit(s.ai_limit())})" if s.use_ai else "false"
    wins = "(fok AND (NOT m OR fdiff < d))" if s.flipped else "false"
    return f"""{_ITEMS}, p AS (SELECT x.id AS a, y.id AS b, x.image AS image, x.duration AS da, y.duration AS db, x.folder = y.folder AS same, x.size = y.size AND x.duration = y.duration AND x.ino = y.ino AND x.dev = y.dev AS link, {', '.join([*sums, *fsums, ai])} FROM s x JOIN s y ON {_NEAR}),
c AS (SELECT *, {', '.join(normal + flipped)} FROM p),
u AS (SELECT *, nok OR {by_ai} AS m, CASE WHEN {by_ai} THEN CAST(1 AS FLOAT) - ai ELSE ndiff END AS d, CASE WHEN nok THEN nalg WHEN {by_ai} THEN 4 ELSE 0 END AS fl FROM c),
r AS (SELECT *, m OR {wins} AS match, CASE WHEN {wins} THEN {'fdiff' if s.flipped else 'd'} ELSE d END AS difference, CASE WHEN {wins} THEN {'falg' if s.flipped else '0'} + 1 ELSE fl END AS flags FROM u)"""


_PLAIN = dict(positions=4, ignore_black=False, ignore_white=False)
_GRAY = MatchSettings(percent=84, flipped=False, **_PLAIN)
_QUORUM = MatchSettings(percent=92, use_phash=True, flipped=False, **_PLAIN)
_BOTH = MatchSettings(percent=84, combine=True, flipped=False, **_PLAIN)
_ALL = MatchSettings(percent=82, combine=True, quorum=0.75, use_ai=True, ai_percent=25, folder_mode="same", exclude_hard_links=True, **_PLAIN)
_PAIRS = 'SELECT a, b, round(CAST(difference AS DOUBLE), 6) AS difference, CAST(flags AS INT) AS flags FROM r WHERE match'


def _found(spark, d, s):
    return matching.matches(snapshots_of(spark, d), s).select("a", "b", K.round6(F.col("difference")).alias("difference"), "flags")


@query(f"WITH {_verdicts(_GRAY)} {_PAIRS}")
def multi_position_verdict(spark, d):
    return _found(spark, d, _GRAY)


@query(f"WITH {_verdicts(_QUORUM)} {_PAIRS}")
def quorum_verdict(spark, d):
    return _found(spark, d, _QUORUM)


@query(f"WITH {_verdicts(_BOTH)} {_PAIRS}")
def combined_verdict(spark, d):
    return _found(spark, d, _BOTH)


@query(f"WITH {_verdicts(_BOTH)} SELECT count(*) FILTER (flags & 24 = 24) AS \"both\", count(*) FILTER (flags & 24 = 8) AS gray_only, count(*) FILTER (flags & 24 = 16) AS phash_only FROM r WHERE match")
def combined_tally(spark, d):
    return matching.tally(snapshots_of(spark, d), _BOTH)


@query(f"WITH {_ITEMS}, p AS (SELECT x.id AS a, y.id AS b, {_ai_sql()} FROM s x JOIN s y ON {_NEAR}) SELECT a, b, round(CAST(ai AS DOUBLE), 6) AS similarity FROM p")
def ai_similarity(spark, d):
    p = matching.candidate_pairs(snapshots_of(spark, d), _ALL)
    sim = matching.ai_similarity(F.col("a.emb"), F.col("a.emb_valid"), F.col("b.emb"), F.col("b.emb_valid"))
    return p.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(sim.cast("double"), 6).alias("similarity"))


@query(f"WITH {_verdicts(_ALL)} {_PAIRS} AND same AND NOT link")
def pair_verdict(spark, d):
    return _found(spark, d, _ALL)


@query(f"""WITH {_verdicts(_ALL)} SELECT a, b, abs(da - db) AS duration_gap, same AS folder_ok, link AS hard_link, round(CAST(ai AS DOUBLE), 6) AS ai, nok AS normal, fok AS flipped,
CASE WHEN image THEN [nb0] ELSE [nb0, nb1, nb2, nb3] END AS hash_distances, match AND same AND NOT link AS match FROM r""")
def pair_diagnostic(spark, d):
    told = matching.diagnosed(snapshots_of(spark, d), _ALL)
    return told.select("a", "b", "duration_gap", "folder_ok", "hard_link", K.round6(F.col("ai")).alias("ai"), "normal", "flipped", "hash_distances", "match")


_NEAR_ONES = MatchSettings(percent=88, flipped=True, **_PLAIN)


@query()
def matched_groups(spark, d):
    """Groups whose representatives and majorities the matcher likes; tested against a plain replay."""
    items = matching.with_mirrored(snapshots_of(spark, d))
    found = matching.matches(items, _NEAR_ONES).select("a", "b", "difference", "flags")
    return building.matched_groups(found, items, _NEAR_ONES).withColumn("difference", F.round("difference", 6))


# Folders and files


@query("""WITH k AS (SELECT page_id AS id, array_to_string(list_concat(['', ''], string_split_regex(regexp_replace(lower(url), '[/\\\\]+$', ''), '[/\\\\]+'))[-2:], '/') AS key FROM pages)
SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.id < y.id""")
def same_folder_pairs(spark, d):
    p = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(matching.folder_keys(F.array("url"), 2)).alias("key"))
    return p.select(F.col("id").alias("a"), "key").join(p.select(F.col("id").alias("b"), "key"), "key").filter("a < b").select("a", "b")


@query("""WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS size, l_suppkey % 7 AS duration, l_suppkey % 2 AS dev, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(l_suppkey % 5 AS VARCHAR) END AS ino, l_linenumber % 3 = 0 AS image FROM lineitem)
SELECT x.o AS oa, x.n AS na, y.o AS ob, y.n AS nb FROM f x JOIN f y ON x.size = y.size AND x.dev = y.dev AND x.ino = y.ino AND x.image = y.image AND (x.image OR x.duration = y.duration) AND x.ino <> '' AND (x.o, x.n) < (y.o, y.n)""")
def hard_link_pairs(spark, d):
    f = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("size"), (F.col("l_suppkey") % 7).alias("duration"), (F.col("l_suppkey") % 2).alias("dev"),
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise((F.col("l_suppkey") % 5).cast("string")).alias("ino"), (F.col("l_linenumber") % 3 == 0).alias("is_image"),
    )
    whole = lambda n: f.select(F.struct(*f.columns).alias(n), F.col("size").alias("s"), F.col("is_image").alias("k"))
    met = whole("a").join(whole("b"), ["s", "k"]).filter(matching.hard_link(F.col("a"), F.col("b")) & (F.struct("a.o", "a.n") < F.struct("b.o", "b.n")))
    return met.select(F.col("a.o").alias("oa"), F.col("a.n").alias("na"), F.col("b.o").alias("ob"), F.col("b.n").alias("nb"))


# Vectors


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 6)) AS unit FROM embeddings")
def unit_vectors(spark, d):
    # a small negative component rounds to -0.0, which Spark's decimal rounding would give as 0.0
    rounded = lambda x: F.when(F.round(x, 6) == 0, F.signum(x) * 0.0).otherwise(F.round(x, 6))
    return read(spark, d, "embeddings").select("vec_id", F.transform(K.unit(F.col("embedding")), rounded).alias("unit"))


def _word_sql(w: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[{32 * w} + i + 1] < 0 THEN 1::BIGINT << CAST(i AS INT) ELSE 0 END)) AS BIGINT)"


@query(f"SELECT vec_id, [{_word_sql(0)}, {_word_sql(1)}] AS words FROM embeddings")
def wide_signature(spark, d):
    return read(spark, d, "embeddings").select("vec_id", K.sign_words(F.col("embedding")).alias("words"))


@query(f"""WITH s AS (SELECT vec_id AS id, label, {_word_sql(0)} AS a, {_word_sql(1)} AS b FROM embeddings)
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)) AS INT) AS distance FROM s x JOIN s y ON x.label = y.label AND x.id < y.id""")
def wide_hamming(spark, d):
    s = read(spark, d, "embeddings").select("vec_id", "label", K.sign_words(F.col("embedding")).alias("w"))
    met = s.select(F.col("vec_id").alias("a"), "label", F.col("w").alias("x")).join(s.select(F.col("vec_id").alias("b"), "label", F.col("w").alias("y")), "label").filter("a < b")
    return met.select("a", "b", K.words_hamming(F.col("x"), F.col("y")).alias("distance"))


@query("""SELECT vec_id, len(list_filter(range(0, 21), lambda i: embedding[i * 3 + 1] < 0 AND embedding[i * 3 + 2] < 0 AND embedding[i * 3 + 3] < 0)) * 100.0 / 21 >= 20 AS dark FROM embeddings""")
def rgb_dark(spark, d):
    px = F.transform("embedding", lambda x: F.when(x < 0, 10).otherwise(200))
    return read(spark, d, "embeddings").select("vec_id", K.rgb_is_dark(px, 20).alias("dark"))


# Partial matches


_TIMELINE = """t AS (SELECT label AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS slot, list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round_even(CAST(x AS DOUBLE) * 127, 0))) AS INT)) AS q FROM embeddings WHERE vec_id % 7 <> 0)"""


@query(f"""WITH {_TIMELINE}, h AS (SELECT x.id AS source, y.id AS clip, CAST((x.slot - y.slot) * 5 AS DOUBLE) AS o, list_dot_product(x.q::DOUBLE[], y.q::DOUBLE[]) / 16129.0 AS sim FROM t x JOIN t y ON x.id < y.id
  WHERE list_dot_product(x.q::DOUBLE[], y.q::DOUBLE[]) / 16129.0 >= 0.2 AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (x.q[i] < 0) <> (y.q[i] < 0) THEN 1 ELSE 0 END)) <= {K.signature_bound(0.2, 64)}),
m AS (SELECT *, row_number() OVER (PARTITION BY source, clip ORDER BY o) AS r, count(*) OVER (PARTITION BY source, clip) AS n FROM h),
k AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN o END) OVER (PARTITION BY source, clip) AS med FROM m)
SELECT source, clip, round(avg(sim), 6) AS similarity, greatest(0.0, any_value(med)) AS "offset", count(*) AS hits FROM k WHERE n >= 4 AND abs(o - med) <= 30 GROUP BY source, clip HAVING count(*) >= 4""")
def dense_containment(spark, d):
    from pyspark.sql import Window as W

    t = read(spark, d, "embeddings").filter("vec_id % 7 <> 0").select(F.col("label").alias("id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("slot"), F.lit(5).alias("interval"), K.quantize(F.col("embedding")).alias("emb"), F.lit(True).alias("valid"))
    ids = t.select("id").distinct()
    met = ids.select(F.col("id").alias("source")).join(ids.select(F.col("id").alias("clip")), F.col("source") < F.col("clip"))
    return partials.dense_matches(t, met, 0.2).withColumn("similarity", F.round("similarity", 6)).select("source", "clip", "similarity", "offset", "hits")


_MATCHES = "SELECT o_custkey AS source, o_orderkey % 500 AS clip, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS similarity, CAST(o_orderkey AS DOUBLE) AS o FROM orders"


def _matches(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("source"), (k % 500).alias("clip"), ((k % 10).cast("double") / 10).alias("similarity"), k.cast("double").alias("offset"))


@query(f"WITH m AS (SELECT * FROM ({_MATCHES}) WHERE (source + clip) % 3 <> 0), f AS (SELECT clip, min(source) AS source FROM m GROUP BY clip) SELECT source, clip, similarity, o AS \"offset\" FROM m JOIN f USING (clip, source)")
def verified_clips(spark, d):
    m = _matches(spark, d)
    verdicts = m.select("source", "clip", ((F.col("source") + F.col("clip")) % 3 != 0).alias("passes")).distinct()
    return partials.verified_clips(m, verdicts)


@query("""WITH s AS (SELECT l_orderkey AS source, l_linenumber AS clip, l_suppkey % 11 = 0 AS abstain, CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 3 END AS n,
  list_filter([CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_discount * 10 AS DOUBLE) END, CASE WHEN l_quantity >= 20 AND l_partkey % 4 <> 1 THEN CAST(l_tax * 10 AS DOUBLE) END, CASE WHEN l_quantity >= 20 AND l_partkey % 4 <> 2 THEN 0.5::DOUBLE END], lambda x: x IS NOT NULL) AS v FROM lineitem)
SELECT source, clip, CASE WHEN abstain THEN true WHEN n = 0 THEN false WHEN len(v) = 0 THEN true ELSE list_avg(v) >= 0.45 END AS passes, round(CASE WHEN abstain OR len(v) = 0 THEN 0 ELSE list_avg(v) END, 6) AS similarity FROM s""")
def visual_confirmation(spark, d):
    q, p = F.col("l_quantity"), F.col("l_partkey") % 4
    times = F.when(q < 5, F.array().cast("array<double>")).when(q < 20, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    sims = F.array(F.when(p != 0, F.col("l_discount").cast("double") * 10), F.when((q >= 20) & (p != 1), F.col("l_tax").cast("double") * 10), F.when((q >= 20) & (p != 2), F.lit(0.5)))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("clip"), (F.col("l_suppkey") % 11 == 0).alias("abstain"), times.alias("times"), sims.alias("similarities"))
    return partials.visual_confirmation(rows, 0.45).withColumn("similarity", F.round("similarity", 6))


_GROUPED = "SELECT o_custkey AS group_id, o_orderkey AS id, 0.0::DOUBLE AS difference, 0 AS flags, 0.0::DOUBLE AS o FROM orders WHERE o_orderkey % 4 = 0"
_CLIPS = "SELECT o_orderkey AS source, o_orderkey + 100000000 AS clip, CAST(o_orderkey % 8 AS DOUBLE) / 8 AS similarity, CAST(o_orderkey % 9 AS DOUBLE) AS o FROM orders WHERE o_orderkey % 6 = 0"


@query(f"""WITH m AS ({_GROUPED}), c AS ({_CLIPS}), h AS (SELECT id, min(group_id) AS home FROM m GROUP BY id), p AS (SELECT c.*, home FROM c LEFT JOIN h ON h.id = c.source),
n AS (SELECT source, (SELECT max(group_id) FROM m) + row_number() OVER (ORDER BY source) AS fresh FROM (SELECT DISTINCT source FROM p WHERE home IS NULL))
SELECT * FROM (SELECT group_id, id, difference, flags, o AS "offset" FROM m UNION ALL SELECT fresh, source, 0, 0, 0 FROM n UNION ALL SELECT coalesce(home, fresh), clip, 1 - similarity, 2, o FROM p LEFT JOIN n USING (source))""")
def emit_partials(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    m = o.filter(k % 4 == 0).select(F.col("o_custkey").alias("group_id"), k.alias("id"), F.lit(0.0).alias("difference"), F.lit(0).alias("flags"), F.lit(0.0).alias("offset"))
    c = o.filter(k % 6 == 0).select(k.alias("source"), (k + 100000000).alias("clip"), ((k % 8).cast("double") / 8).alias("similarity"), (k % 9).cast("double").alias("offset"))
    return partials.emit_groups(c, m, K.PARTIAL_CLIP)


@query("""WITH m AS (SELECT o_custkey AS g, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT g FROM m WHERE g % 5 <> 0 GROUP BY g HAVING count(*) >= 2), n AS (SELECT g, row_number() OVER (ORDER BY g) AS k FROM s)
SELECT k AS group_id, id FROM m JOIN n USING (g)""")
def final_groups(spark, d):
    m = read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("id"))
    return partials.final_groups(m, m.filter("group_id % 5 = 0").select("group_id").distinct()).select("group_id", "id")


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS rank, o_orderkey % 3 <> 0 AS clip_ok FROM orders""")
def clip_roles(spark, d):
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("duration"), F.col("o_orderkey").alias("idx"))
    return partials.clip_roles(partials.longest_first(items), items.filter("id % 3 = 0").select("id")).select("id", F.col("rank").cast("long").alias("rank"), "clip_ok")


@query("""SELECT l_orderkey AS a, l_linenumber AS n, CASE WHEN CAST(l_quantity AS DOUBLE) - l_linenumber * 5 >= 0 THEN CAST(l_quantity AS DOUBLE) - l_linenumber * 5 END AS t, [CAST(l_quantity AS DOUBLE) + l_linenumber, CAST(l_quantity AS DOUBLE) * 2 + l_linenumber] AS positions FROM lineitem""")
def clip_times(spark, d):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), n.alias("n"), partials.clip_time(q, n * 5).alias("t"), partials.pair_positions(F.array(q, q * 2), n, True).alias("positions"))


# Reuse and eligibility


_OLD = "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) + CAST(o_orderkey % 13 = 0 AS INT) AS size, o_orderkey % 1000 + CAST(o_orderkey % 7 = 0 AS INT) AS mtime, o_orderkey % 5 AS h, o_orderkey * 2 AS fp FROM orders WHERE o_orderkey % 11 <> 0"


@query(f"""WITH n AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 1000 AS mtime, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 4 END AS h FROM orders), o AS ({_OLD}),
r AS (SELECT n.id, o.fp, coalesce(n.size = o.size AND (n.mtime = o.mtime OR n.h = o.h), false) AS reused FROM n LEFT JOIN o USING (id)) SELECT id, CASE WHEN reused THEN fp END AS fp, reused FROM r""")
def entry_reuse(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    size = F.floor("o_totalprice").cast("long")
    items = o.select(k.alias("id"), size.alias("size"), (k % 1000).alias("mtime"), F.when(k % 3 == 0, k % 5).otherwise(k % 4).alias("os_hash"))
    old = o.filter(k % 11 != 0).select(k.alias("id"), (size + (k % 13 == 0).cast("int")).alias("size"), (k % 1000 + (k % 7 == 0).cast("int")).alias("mtime"), (k % 5).alias("os_hash"), (k * 2).alias("fp"))
    return snapshots.reuse(items, old).select("id", "fp", "reused")


@query("""SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'link' WHEN event_id % 11 = 0 THEN 'read-only' WHEN (event_id % 32) & 28 <> 0 THEN 'failed before' END AS reason FROM events""")
def runtime_rejects(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select(k.alias("id"), snapshots.runtime_reason(k % 17 == 0, k % 13 == 0, k % 11 == 0, (k % 32).cast("int"), skip_read_only=True).alias("reason"))


@query("""SELECT event_id AS id, event_id % 6 <> 0 AND (event_id % 32) & 22 = 0 AND event_id % 4 = 0 AS eligible FROM events""")
def snapshot_eligibility(spark, d):
    k = F.col("event_id")
    frame = lambda n: F.encode(F.repeat(F.lit("x"), n), "utf-8")
    frames = F.create_map(F.lit(0.25), frame(F.lit(1024)), F.lit(0.5), frame(F.when(k % 2 == 0, 1024).otherwise(1000)))
    whole = snapshots.complete(frames, F.when(k % 4 < 2, F.array(F.lit(0.25), F.lit(0.5))).otherwise(F.array(F.lit(0.25), F.lit(0.75))))
    return read(spark, d, "events").select(k.alias("id"), snapshots.eligible(k % 6 != 0, (k % 32).cast("int"), whole).alias("eligible"))


@query("SELECT user_id AS id, bool_and(event_id % 3 = 0 OR event_type = 'click') AS too_dark FROM events GROUP BY user_id")
def too_dark_videos(spark, d):
    e = read(spark, d, "events")
    px = F.when((F.col("event_id") % 3 == 0) | (F.col("event_type") == "click"), F.array_repeat(F.lit(10), 10)).otherwise(F.array_repeat(F.lit(99), 10))
    return snapshots.too_dark(e.select(F.col("user_id").alias("id"), px.alias("px")))
