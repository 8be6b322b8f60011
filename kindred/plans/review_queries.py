"""Queries of scopes, of the review of results, of selections and of the commands on the fingerprint table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from kindred.functions import display, kernels as K
from kindred.functions.expression import compile_expression
from kindred.operators import results, review, scope, selection
from kindred.plans.registry import query, read
from kindred.plans.settings import ScanSettings
from kindred.sources import cache, media, store

_ROWS = """SELECT o_orderkey // 6 AS group_id, o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS size, o_custkey % 50 AS duration, (o_custkey % 3) * 400 AS frame_size, (o_orderkey * 37) % 900 AS bit_rate, CAST(o_orderkey % 4 * 15 AS DOUBLE) AS fps,
  (o_orderkey * 13) % 320 AS audio_bit_rate, o_custkey % 2 * 22050 AS audio_sample_rate, CASE o_orderkey % 5 WHEN 0 THEN 'HLG' WHEN 1 THEN 'HDR10' WHEN 2 THEN 'Dolby Vision' ELSE '' END AS hdr, (o_orderkey // 6) % 6 = 0 AS is_image,
  o_orderstatus AS format, substr(o_orderpriority, 1, 1) AS audio_format, o_orderkey % 2 AS audio_channels, CAST((o_orderkey * 31) % 101 AS DOUBLE) AS similarity, o_orderdate AS created, CAST(o_orderkey % 32 AS INT) AS flags,
  o_orderkey % 23 = 0 AS tombstone, o_custkey % 29 = 0 AS gone, o_custkey % 31 = 0 AS missing, o_orderkey % 3 = 1 AS checked, o_orderkey % 7 <> 0 AS visible, concat('n', o_orderkey % 9) AS name, CAST(o_custkey % 100 AS VARCHAR) AS ext, concat(o_orderstatus, '/', o_orderkey % 9) AS path FROM orders WHERE o_custkey IS NOT NULL"""
R = f"WITH g AS ({_ROWS})"


def rows_of(spark, d):
    """Result rows of the orders, six to a group."""
    sql = _ROWS.replace("o_orderkey // 6", "o_orderkey div 6").replace("AS VARCHAR", "AS STRING").replace("FROM orders", "FROM {t}")
    return spark.sql(sql, t=read(spark, d, "orders"))


# Scope


@query("""SELECT c_custkey AS id, coalesce(c_mktsegment, '') AS name, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END, 0) AS width, CASE WHEN c_custkey % 3 = 0 THEN ['a'] ELSE [] END AS tags FROM customer""")
def item_normalise(spark, d):
    k = F.col("c_custkey")
    c = read(spark, d, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("width"), F.when(k % 3 == 0, F.array(F.lit("a"))).alias("tags"))
    return scope.normalised_items(c)


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey >= 3 THEN n_nationkey // 3 END AS parent FROM nation), r(id, path, depth) AS (
  SELECT id, name, 0 FROM f WHERE parent IS NULL OR parent NOT IN (SELECT id FROM f) UNION ALL SELECT f.id, r.path || '/' || f.name, r.depth + 1 FROM f JOIN r ON f.parent = r.id) SELECT id, path, depth FROM r""")
def folder_paths(spark, d):
    f = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr("CASE WHEN n_nationkey >= 3 THEN n_nationkey div 3 END").alias("parent"))
    return scope.folder_paths(f)


@query("""WITH RECURSIVE f AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS rule, CASE WHEN n_nationkey >= 3 THEN n_nationkey // 3 END AS parent FROM nation), r(id, depth) AS (
  SELECT id, 0 FROM f WHERE parent IS NULL UNION ALL SELECT f.id, r.depth + 1 FROM f JOIN r ON f.parent = r.id) SELECT id, name, depth, rule FROM r JOIN f USING (id)""")
def smart_folders(spark, d):
    f = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("rule"), F.expr("CASE WHEN n_nationkey >= 3 THEN n_nationkey div 3 END").alias("parent"))
    return scope.smart_folders(f)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def items_by_ids(spark, d):
    ids = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return scope.by_ids(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), ids).withColumnRenamed("id", "c_custkey")


_INSIDE = "list_has_any(f, [2, 6, 7, 8, 18, 19, 20, 21, 22, 23, 24])"


@query(f"""WITH i AS (SELECT s_suppkey AS id, [s_nationkey, (s_nationkey * 7 + 1) % 25] AS f FROM supplier), k AS (SELECT * FROM i WHERE NOT (list_has_any(f, [4, 12, 13, 14])))
SELECT CAST(id AS VARCHAR) AS id, {_INSIDE} AS in_scope FROM k""")
def scope_folders(spark, d):
    """Items of folder 2 and what lies under it, compared against the rest, without those of folder 4 and under it."""
    text = lambda c: c.cast("string")
    items = read(spark, d, "supplier").select(text(F.col("s_suppkey")).alias("id"), F.array(text(F.col("s_nationkey")), text((F.col("s_nationkey") * 7 + 1) % 25)).alias("folders"), F.array(F.lit("t")).alias("tags"))
    folders = read(spark, d, "nation").select(text(F.col("n_nationkey")).alias("id"), F.expr("CASE WHEN n_nationkey >= 3 THEN CAST(n_nationkey div 3 AS STRING) END").alias("parent"))
    s = dataclasses.replace(ScanSettings(), scope_mode="folders", scope_folder_ids=("2",), exclude_folder_ids=("4",))
    return scope.scoped(items, s, folders, against_rest=True).select("id", "in_scope")


@query("""WITH i AS (SELECT s_suppkey AS id, s_suppkey % 4 AS t FROM supplier) SELECT 'any' AS mode, CAST(id AS VARCHAR) AS id FROM i WHERE t IN (1, 2) UNION ALL SELECT 'selection', CAST(id AS VARCHAR) FROM i WHERE id % 5 = 0 AND t <> 0
UNION ALL SELECT 'smart', CAST(id AS VARCHAR) FROM i WHERE id > 7 UNION ALL SELECT 'library', CAST(id AS VARCHAR) FROM i""")
def scope_modes(spark, d):
    items = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.lit("f")).alias("folders"), F.array(F.concat(F.lit("Tag"), (F.col("s_suppkey") % 4).cast("string"))).alias("tags"), F.col("s_suppkey").alias("k"))
    base = ScanSettings()
    some = {
        "any": (dataclasses.replace(base, scope_mode="tags", scope_tags=("tag1", "TAG2")), {}),
        "selection": (dataclasses.replace(base, scope_mode="selection", exclude_tags=("tag0",)), {"selection": items.filter("k % 5 = 0").select("id")}),
        "smart": (dataclasses.replace(base, scope_mode="smartFolders", scope_folder_ids=("s1",)), {"smart": {"s1": F.col("k") > 7, "s2": F.lit(True)}}),
        "library": (base, {}),
    }
    out = None
    for mode, (s, more) in some.items():
        one = scope.scoped(items, s, **more).select(F.lit(mode).alias("mode"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH v AS (SELECT p_partkey AS id, list_concat(list_transform(CASE WHEN p_size % 3 = 0 THEN [] ELSE string_split(p_type, ' ') END, lambda f: f || '/' || p_name || '.mp4'), CASE WHEN p_size % 3 = 0 THEN [p_name || '.mp4'] ELSE [] END, ['/m/' || p_brand]) AS p FROM part)
SELECT id, p AS paths FROM v WHERE len(list_filter(p, lambda x: regexp_matches(x, '^.*E.*/.*A.*$', 'is'))) > 0 AND len(list_filter(p, lambda x: regexp_matches(x, '^/m/.*3$', 'is'))) = 0""")
def virtual_paths(spark, d):
    folders = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("p_type", " "))
    paths = scope.virtual_paths(folders, F.col("p_name"), F.lit("mp4"), F.concat(F.lit("/m/"), "p_brand"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), paths.alias("paths"))
    return p.filter(scope.matches_any(F.col("paths"), ["*E*/*A*"]) & ~scope.matches_any(F.col("paths"), ["/m/*3"]))


@query("""SELECT doc_id AS id, CASE WHEN source IS NULL OR source NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'unsupported' WHEN source IN ('src0', 'src1') THEN 'images off' END AS reason FROM documents""")
def kind_rejects(spark, d):
    kind = K.item_kind(F.col("source"), ["src0", "src1"], ["src2", "src3"])
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), scope.kind_reason(kind, False, True).alias("reason"))


@query("""WITH v AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'ab' || event_id WHEN 1 THEN '../' || event_id WHEN 2 THEN '' WHEN 3 THEN 'a b' ELSE '.' END AS t FROM events)
SELECT id, regexp_full_match(t, '[A-Za-z0-9]{1,64}') AS is_id, t <> '' AND NOT contains(t, '/') AND t NOT IN ('.', '..') AS is_name, regexp_full_match(t, '[A-Za-z0-9]{1,16}') AS is_ext, regexp_full_match(t, '[A-Za-z0-9._-]{1,64}') AND NOT contains(t, '..') AS is_suffix FROM v""")
def validators(spark, d):
    k = F.col("event_id")
    t = F.when(k % 5 == 0, F.concat(F.lit("ab"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("../"), k.cast("string"))).when(k % 5 == 2, "").when(k % 5 == 3, "a b").otherwise(".")
    v = read(spark, d, "events").select(k.alias("id"), t.alias("t"))
    c = F.col("t")
    return v.select("id", scope.valid_id(c).alias("is_id"), scope.valid_name(c).alias("is_name"), scope.valid_extension(c).alias("is_ext"), scope.valid_suffix(c).alias("is_suffix"))


@query("SELECT event_id, event_type AS level, props AS message FROM events WHERE event_type = 'click' AND contains(lower(props), '7')")
def log_filter(spark, d):
    log = read(spark, d, "events").select("event_id", F.col("event_type").alias("level"), F.col("props").alias("message"))
    return scope.log_lines(log, "click", "7")


# Results


@query(f"""{R}, m AS (SELECT *, min_by(is_image, idx) OVER w AS im, CASE hdr WHEN 'Dolby Vision' THEN 4 WHEN 'HDR10' THEN 2 WHEN 'HLG' THEN 1 ELSE 0 END AS rank FROM g WINDOW w AS (PARTITION BY group_id))
SELECT group_id, idx, NOT im AND duration = max(duration) OVER w AS is_best_duration, NOT im AND fps = max(fps) OVER w AS is_best_fps, NOT im AND bit_rate = max(bit_rate) OVER w AS is_best_bit_rate, NOT im AND audio_sample_rate = max(audio_sample_rate) OVER w AS is_best_audio_sample_rate,
NOT im AND audio_bit_rate = max(audio_bit_rate) OVER w AS is_best_audio_bit_rate, NOT im AND rank = max(rank) OVER w AS is_best_hdr, frame_size = max(frame_size) OVER w AS is_best_frame_size, size = min(size) OVER w AS is_best_size FROM m WINDOW w AS (PARTITION BY group_id)""")
def highlight_best(spark, d):
    out = results.highlight_best(rows_of(spark, d))
    return out.select("group_id", "idx", *[c for c in out.columns if c.startswith("is_best_")])


def _signed(c: str, best: str, above: str) -> str:
    p = f"(({c} - {best}) / CAST({best} AS DOUBLE) * 100.0)"
    return f"CASE WHEN {best} > {above} THEN CASE WHEN abs({p}) < 0.5 THEN '=' ELSE CASE WHEN {p} < 0 THEN '-' ELSE '+' END || CAST(floor(abs({p}) + 0.5) AS BIGINT) || '%' END END"


@query(f"""{R}, b AS (SELECT *, {', '.join(f'max({c}) OVER w AS x_{c}, min({c}) OVER w AS n_{c}' for c in ('size', 'frame_size', 'fps', 'bit_rate', 'audio_bit_rate'))} FROM g WINDOW w AS (PARTITION BY group_id))
SELECT group_id, idx, CASE WHEN x_size = n_size THEN NULL WHEN size = n_size THEN 'BEST' ELSE {_signed('size', 'n_size', '0')} END AS diff_size,
{', '.join(f"CASE WHEN x_{c} = n_{c} THEN NULL WHEN {c} = x_{c} THEN 'BEST' ELSE {_signed(c, 'x_' + c, '0.01' if c == 'fps' else '0')} END AS diff_{c}" for c in ('frame_size', 'fps', 'bit_rate', 'audio_bit_rate'))} FROM b""")
def hover_all(spark, d):
    return results.hover_all(rows_of(spark, d)).select("group_id", "idx", "diff_size", "diff_frame_size", "diff_fps", "diff_bit_rate", "diff_audio_bit_rate")


@query(f"""{R}, v AS (SELECT *, bool_or(flags & 1 <> 0) OVER w AS fl, bool_or(flags & 4 <> 0) OVER w AS ai, bool_or(tombstone OR gone) OVER w AS dl, max(similarity) OVER w AS top FROM g WINDOW w AS (PARTITION BY group_id))
SELECT idx, fl AND ai AND dl AND top >= 60 AND NOT is_image AND NOT checked AND contains(lower(name || '.' || ext), 'n2') AS visible FROM v WHERE NOT checked OR true""".replace("AND NOT checked AND", "AND checked AND").replace(" WHERE NOT checked OR true", ""))
def result_visibility(spark, d):
    return review.visible(rows_of(spark, d), kind="videos", checked_only=True, text="N2", flipped=True, ai=True, deleted=True, least_similarity=60).select("idx", "visible")


@query(f"""{R}, s AS (SELECT group_id, CAST(sum(size) - max(size) AS BIGINT) AS k FROM g GROUP BY group_id) SELECT group_id, k AS key, row_number() OVER (ORDER BY k DESC, group_id) AS place FROM s""")
def group_order(spark, d):
    return review.ordered_groups(rows_of(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"{R}, s AS (SELECT group_id, lower(arg_min(name, idx)) AS k FROM g GROUP BY group_id) SELECT group_id, k AS key, row_number() OVER (ORDER BY k, group_id) AS place FROM s")
def group_order_by_name(spark, d):
    return review.ordered_groups(rows_of(spark, d), "name", False).withColumn("place", F.col("place").cast("long"))


@query(f"""{R}, v AS (SELECT DISTINCT group_id FROM g WHERE visible), w AS (SELECT sum(size) - max(size) AS w FROM g JOIN v USING (group_id) GROUP BY group_id)
SELECT (SELECT count(*) FROM w) AS groups, CAST((SELECT sum(w) FROM w) AS BIGINT) AS wasted, (SELECT count(*) FROM g WHERE visible) AS files, (SELECT count(*) FROM g WHERE checked) AS checked, CAST((SELECT sum(size) FROM g WHERE checked) AS BIGINT) AS checked_bytes""")
def header_stats(spark, d):
    return review.header(rows_of(spark, d))


@query(f"{R} SELECT group_id, bit_or(flags) AS flags FROM g GROUP BY group_id")
def group_flags(spark, d):
    return review.group_flags(rows_of(spark, d))


@query(f"""{R}, r AS (SELECT group_id, count(*) FILTER (NOT checked) AS kept, count(*) FILTER (checked) AS removed, CAST(sum(size) FILTER (checked) AS BIGINT) AS freed FROM g GROUP BY group_id HAVING count(*) FILTER (checked) > 0)
SELECT group_id, 0::BIGINT AS line_no, 'Group ' || group_id AS line FROM r UNION ALL SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY idx), CASE WHEN checked THEN '  REMOVE ' ELSE '  KEEP   ' END || path FROM g WHERE group_id IN (SELECT group_id FROM r)
UNION ALL SELECT group_id, kept + removed + 1, '  frees ' || freed || ' bytes' FROM r UNION ALL SELECT group_id, removed + 2, '  WARNING: nothing of this group is kept' FROM r WHERE kept = 0
UNION ALL SELECT NULL, 0, printf('Total: %d groups, %d files, %d bytes', count(*), CAST(sum(removed) AS BIGINT), CAST(sum(freed) AS BIGINT)) FROM r""")
def dry_run_lines(spark, d):
    return review.dry_run_lines(rows_of(spark, d))


@query(f"""{R}, s AS (SELECT group_id, row_number() OVER (ORDER BY CAST(sum(size) - max(size) AS BIGINT) DESC, group_id) AS place FROM g GROUP BY group_id)
SELECT place, idx, '"' || group_id || '","' || name || '","' || path || '","' || array_to_string([format, audio_format], '; ') || '","' || checked || '"' AS line FROM g JOIN s USING (group_id)""")
def csv_rows(spark, d):
    g = rows_of(spark, d)
    order = review.ordered_groups(g)
    with_tags = g.withColumn("tags", F.array("format", "audio_format")).join(order.select("group_id", F.col("place").cast("long").alias("place")), "group_id")
    return results.csv_lines(with_tags, ["group_id", "name", "path", "tags", "checked"], ["place", "idx"])


@query(f"{R}, l AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 2 = 0) SELECT idx, coalesce(s_name, name) AS name, k IS NULL AS gone FROM g LEFT JOIN l ON CAST(k AS VARCHAR) = ext")
def live_enrichment(spark, d):
    live = read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("ext"), F.array().cast("array<string>").alias("folders"), F.array().cast("array<string>").alias("tags"))
    rows = rows_of(spark, d).select("idx", F.col("ext").alias("id"), "name", "ext")
    return review.with_live(rows, live).select("idx", "name", "gone")


@query("""WITH e AS (SELECT event_id % 300 AS id, 1 + event_id % 3 AS channels, event_id FROM events), s AS (SELECT event_id, id % 7 = 0 AS im, channels FROM e)
SELECT event_id AS id, im AS is_image, CASE WHEN im THEN 0 ELSE 61 END::BIGINT AS duration, CASE WHEN im THEN 'jpg' ELSE 'h264' END AS format, CASE WHEN im THEN '640x360' ELSE '1280x720' END AS frame_size, CASE WHEN im THEN 1000 ELSE 2000 END AS frame_size_int, CASE WHEN im THEN 0 ELSE 2 END::BIGINT AS bit_rate,
CASE WHEN im THEN '' ELSE 'aac' END AS audio_format, CASE WHEN im THEN 0 ELSE greatest(channels, 2) END::INTEGER AS audio_channels, CASE WHEN im THEN '' WHEN channels = 1 THEN '?, GER' ELSE 'ENG, GER' END AS audio_languages FROM s""")
def described_results(spark, d):
    e = read(spark, d, "events")
    text = F.concat(
        F.lit('{"format":{"duration":"61.9"},"streams":[{"index":0,"codec_name":"png","codec_type":"video","width":640,"height":360},{"index":1,"codec_name":"h264","codec_type":"video","width":1280,"height":720,"bit_rate":"2500"},{"index":2,"codec_name":"aac","codec_type":"audio","channels":'),
        (F.col("event_id") % 3 + 1).cast("string"), F.lit(',"tags":{"language":"'), F.when(F.col("event_id") % 3 == 0, "und").otherwise("eng"), F.lit('"}},{"index":3,"codec_name":"aac","codec_type":"audio","channels":2,"tags":{"language":"deu"}}]}'),
    )
    m = e.select(
        F.col("event_id").alias("id"), F.lit(1).alias("group_id"), F.lit(0.1).alias("difference"), F.lit(0).alias("flags"), F.lit(None).cast("double").alias("offset"), F.when(F.col("event_id") % 300 % 7 == 0, 1).otherwise(0).alias("entry_flags"), media.media_info(text).alias("info"),
        F.lit("n").alias("name"), F.lit("JPG").alias("ext"), F.lit("p").alias("path"), F.lit(5).alias("size"), F.lit(0).alias("created"), F.lit(0).alias("modified"), F.array(F.lit(0.5)).alias("positions"),
    )
    return review.described(m).select("id", "is_image", "duration", "format", "frame_size", "frame_size_int", "bit_rate", "audio_format", "audio_channels", "audio_languages")


@query(f"""{R} SELECT idx, CASE WHEN len(list_filter([1.0, 2.5, 7.0], lambda p: p > fps / 10 + 0.01)) > 0 THEN list_min(list_filter([1.0, 2.5, 7.0], lambda p: p > fps / 10 + 0.01)) ELSE 1.0 END::DOUBLE AS next,
CASE WHEN len(list_filter([1.0, 2.5, 7.0], lambda p: p < fps / 10 - 0.01)) > 0 THEN list_max(list_filter([1.0, 2.5, 7.0], lambda p: p < fps / 10 - 0.01)) ELSE 7.0 END::DOUBLE AS last FROM g""")
def jump_positions(spark, d):
    p, now = F.array(F.lit(1.0), F.lit(2.5), F.lit(7.0)), F.col("fps") / 10
    return rows_of(spark, d).select("idx", review.next_position(p, now).alias("next"), review.next_position(p, now, False).alias("last"))


@query(f"""{R}, p AS (SELECT *, lead(hdr) OVER (PARTITION BY group_id ORDER BY idx) AS o FROM g), r AS (SELECT idx, {', '.join(f"CASE {c} WHEN 'Dolby Vision' THEN 4 WHEN 'HDR10' THEN 2 WHEN 'HLG' THEN 1 ELSE 0 END AS {n}" for c, n in (('hdr', 'a'), ('o', 'b')))}, o IS NULL AS alone FROM p)
SELECT idx, CASE WHEN alone OR a = b THEN 'neutral' WHEN a > b THEN 'better' ELSE 'worse' END AS chip FROM r""")
def hdr_chips(spark, d):
    from pyspark.sql import Window as W

    return rows_of(spark, d).select("idx", display.hdr_chip(F.col("hdr"), F.lead("hdr").over(W.partitionBy("group_id").orderBy("idx"))).alias("chip"))


# Selection


@query(f"{R} SELECT idx, CASE WHEN l_kbps > 0 AND fps > 0 AND frame_size > 0 THEN l_kbps * 1000.0 / (frame_size * 100.0 * fps) ELSE 0 END::DOUBLE AS bpp FROM (SELECT *, bit_rate AS l_kbps FROM g)")
def bits_per_pixel(spark, d):
    size = F.concat(F.col("frame_size").cast("string"), F.lit("x100"))
    return rows_of(spark, d).select("idx", selection.bits_per_pixel(F.col("bit_rate"), size, F.col("fps")).alias("bpp"))


def _keeper_sql(of: str, last: str) -> str:
    """The chain of all seven criteria over rows ``of``, each step in its own CTE."""
    steps, before = [f"k0 AS (SELECT *, true AS c, false AS done, CAST(NULL AS BIGINT) AS k FROM {of})"], "k0"
    ties = {"duration": "abs({v} - b) <= 1 OR abs({v} - b) <= abs(b) * 0.01", "fps": "abs({v} - b) <= 0.5"}
    for i, c in enumerate(("duration", "frame_size", "bit_rate", "fps", "bits_per_pixel", "audio_bit_rate", "size"), 1):
        v = f"CAST({c} AS DOUBLE)"
        best = f"{'min' if c == 'size' else 'max'}(CASE WHEN c THEN {v} END) OVER w"
        tie = ties.get(c, "abs({v} - b) <= abs(b) * 0.05" if "bit" in c else "{v} = b").format(v=v)
        steps.append(f"a{i} AS (SELECT *, {best} AS b FROM {before} WINDOW w AS (PARTITION BY group_id))")
        steps.append(f"b{i} AS (SELECT * EXCLUDE (k), CASE WHEN done THEN k ELSE min(CASE WHEN c AND {v} = b THEN idx END) OVER w END AS k FROM a{i} WINDOW w AS (PARTITION BY group_id))")
        steps.append(f"c{i} AS (SELECT * EXCLUDE (c, b), CASE WHEN done THEN c ELSE c AND ({tie}) END AS c FROM b{i})")
        steps.append(f"k{i} AS (SELECT * EXCLUDE (done), done OR sum(CAST(c AS INT)) OVER w <= 1 AS done FROM c{i} WINDOW w AS (PARTITION BY group_id))")
        before = f"k{i}"
    return f"{', '.join(steps)} {last.format(k=before)}"


_BPP = "p AS (SELECT *, CASE WHEN bit_rate > 0 AND fps > 0 AND frame_size > 0 THEN bit_rate * 1000.0 / (frame_size * 100.0 * fps) ELSE 0 END::DOUBLE AS bits_per_pixel FROM g)"


def _with_bits(rows):
    return rows.withColumn("bits_per_pixel", selection.bits_per_pixel(F.col("bit_rate"), F.concat(F.col("frame_size").cast("string"), F.lit("x100")), F.col("fps")))


@query(f"{R}, {_BPP}, {_keeper_sql('p', 'SELECT group_id, idx, idx = k AS keeper FROM {k}')}")
def keeper_all(spark, d):
    return selection.keepers(_with_bits(rows_of(spark, d)), list(selection.CRITERIA)).select("group_id", "idx", "keeper")


@query(f"{R}, {_BPP}, {_keeper_sql('p', 'SELECT group_id, idx, row_number() OVER (PARTITION BY group_id ORDER BY idx = k DESC, idx) AS place FROM {k}')}")
def best_first(spark, d):
    return review.best_first(_with_bits(rows_of(spark, d)), list(selection.CRITERIA)).select("group_id", "idx", F.col("place").cast("long").alias("place"))


@query(f"{R}, {_BPP}, v AS (SELECT * FROM p WHERE visible), {_keeper_sql('v', ', m AS (SELECT group_id, idx, idx <> k AS mark, count(*) OVER (PARTITION BY group_id) AS n FROM {k}) SELECT g.idx, CASE WHEN m.n >= 2 THEN m.mark ELSE g.checked END AS checked FROM g LEFT JOIN m USING (group_id, idx)')}")
def keep_best(spark, d):
    return selection.keep_best(_with_bits(rows_of(spark, d)), list(selection.CRITERIA)).select("idx", "checked")


@query(f"{R} SELECT idx, CASE WHEN visible THEN NOT checked ELSE checked END AS inverted, false AS cleared FROM g")
def invert_and_clear(spark, d):
    g = rows_of(spark, d)
    return selection.invert(g).select("idx", F.col("checked").alias("inverted")).join(selection.clear(g).select("idx", F.col("checked").alias("cleared")), "idx")


@query(f"{R}, f AS (SELECT group_id, max(idx) AS k FROM g WHERE group_id % 2 = 0 GROUP BY group_id) SELECT g.idx, CASE WHEN k IS NULL THEN checked ELSE g.idx <> k END AS checked FROM g LEFT JOIN f USING (group_id)")
def keep_focused(spark, d):
    g = rows_of(spark, d)
    return selection.keep_only(g, g.filter("group_id % 2 = 0").groupBy("group_id").agg(F.max("idx").alias("idx"))).select("idx", "checked")


@query(f"""{R}, m AS (SELECT *, visible AND NOT is_image AND contains(lower(path), 'f') AND similarity <= 90 AND NOT bool_or(checked AND visible) OVER (PARTITION BY group_id) AS m, sum(CAST(visible AS INT)) OVER (PARTITION BY group_id) AS shown FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id, m ORDER BY created, idx) AS r FROM m), c AS (SELECT *, CASE WHEN m THEN r > 1 ELSE checked END AS c FROM r),
d AS (SELECT *, bool_or(tombstone OR gone) OVER (PARTITION BY group_id) AND NOT (tombstone OR gone) AND NOT missing AS back FROM c) SELECT idx, c OR back AS checked FROM d""")
def after_scan(spark, d):
    preset = selection.CustomSelection(kind="videos", contains=("*f*",), most_similarity=90.0, keep_date="oldest")
    return selection.after_scan(rows_of(spark, d).withColumns({"size_mb": F.lit(1), "paths": F.array("path")}), preset, True).select("idx", "checked")


@query(f"""{R}, m AS (SELECT *, visible AND similarity >= 2 AS m FROM g), f AS (SELECT group_id, min(idx) AS f FROM m WHERE m GROUP BY group_id), x AS (SELECT m.*, f.f, y.frame_size AS a, y.format AS b, y.audio_format AS e, y.audio_channels AS h, y.audio_sample_rate AS s, y.duration AS du, y.bit_rate AS br, y.fps AS fp FROM m LEFT JOIN f USING (group_id) LEFT JOIN m y ON y.idx = f.f),
i AS (SELECT *, m AND (idx = f OR NOT (duration = du AND frame_size = a AND format = b AND audio_format = e AND audio_channels = h AND audio_sample_rate = s AND bit_rate = br AND fps = fp AND size = (SELECT z.size FROM g z WHERE z.idx = x.f))) AS c FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id, c ORDER BY idx) AS r FROM i) SELECT idx, CASE WHEN c THEN r > 1 ELSE checked END AS checked FROM r""")
def custom_different(spark, d):
    s = selection.CustomSelection(skip_checked=False, identical="different", least_similarity=2.0)
    return selection.check_custom(rows_of(spark, d).withColumns({"size_mb": F.lit(1), "paths": F.array("path")}), s).select("idx", "checked")


@query("""WITH g AS (SELECT n_regionkey AS g, list(n_nationkey ORDER BY n_nationkey) AS i FROM nation GROUP BY n_regionkey)
SELECT g AS group_id, [i[2], i[1], i[4]] AS checked, CASE WHEN len(i) >= 5 THEN i[3] END AS "left", CASE WHEN len(i) >= 5 THEN i[5] END AS "right" FROM g""")
def walk_decisions(spark, d):
    rows = read(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("idx"))
    told = rows.select("group_id").distinct().select("group_id", F.posexplode(F.array(F.lit("keepLeft"), F.lit("keepRight"), F.lit("keepLeft"))).alias("step", "decision"))
    return selection.walk(rows, told)


@query(f"""{R} SELECT idx FROM g WHERE NOT is_image AND (flags & 1 <> 0 OR flags & 4 <> 0) AND contains(hdr, 'HDR') AND duration / 60.0 < 0.5 AND regexp_matches(path, '^[FO]/[0-9]')""")
def item_expression(spark, d):
    m = rows_of(spark, d)
    text = 'item.IsImage == false && (item.IsFlipped || item.IsAiMatched) && item.HdrFormat.Contains("HDR") && item.Duration.TotalMinutes < 0.5 && Regex.Match(item.Path, "(?i)^[FO]/[0-9]").Success'
    return m.filter(compile_expression(text, m.dtypes, item=True)).select("idx")


# The fingerprint table


_FLAGS = "SELECT doc_id AS id, lang AS name, source AS ext, n_chars AS size, CAST(quality + toxic * 16 + doc_id % 2 * 65536 + doc_id % 3 * 2 AS INT) AS flags FROM documents JOIN labels USING (doc_id)"


def _entries(spark, d):
    flags = F.expr("CAST(quality + toxic * 16 + doc_id % 2 * 65536 + doc_id % 3 * 2 AS INT)")
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("source").alias("ext"), F.col("n_chars").alias("size"), flags.alias("flags"))


@query(f"WITH e AS ({_FLAGS}) SELECT * FROM e WHERE id % 3 <> 0 OR flags & 65536 <> 0")
def db_cleanup(spark, d):
    e = _entries(spark, d)
    return cache.cleanup(e, e.filter("id % 3 <> 0").select("id"), True)


@query(f"WITH e AS ({_FLAGS}) SELECT id, name, ext, size, CASE WHEN id % 4 = 0 THEN flags | 2 ELSE flags END AS flags FROM e UNION ALL SELECT -1, NULL, NULL, NULL, 2")
def db_exclude(spark, d):
    e = _entries(spark, d)
    return cache.exclude(e, e.filter("id % 4 = 0").select("id").union(spark.range(1).selectExpr("CAST(-1 AS LONG) AS id")))


@query(f"WITH e AS ({_FLAGS}) SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE name END AS name, CASE WHEN id % 4 = 0 THEN flags & ~252 ELSE flags END AS flags FROM e")
def db_clear_entries(spark, d):
    e = _entries(spark, d)
    return cache.clear_entries(e, e.filter("id % 4 = 0").select("id"), ["name"]).select("id", "name", "flags")


@query(f"WITH e AS ({_FLAGS}) SELECT id, CASE WHEN id % 5 = 0 THEN flags | 65536 WHEN id % 5 = 1 THEN flags & ~65536 ELSE flags END AS flags FROM e")
def db_mark_deleted(spark, d):
    e = _entries(spark, d)
    marked = cache.mark_deleted(e, e.filter("id % 5 = 0").select("id"), True)
    return cache.restore_deleted(marked, e.filter("id % 5 = 1").select("id")).select("id", "flags")


@query(f"WITH e AS ({_FLAGS}) SELECT id, 'excluded' AS list FROM e WHERE flags & 2 <> 0 UNION ALL SELECT id, 'retry' FROM e WHERE flags & 92 <> 0")
def db_lists(spark, d):
    e = _entries(spark, d)
    return cache.excluded(e).select("id", F.lit("excluded").alias("list")).unionByName(cache.failed(e).withColumn("list", F.lit("retry")))


@query(f"WITH e AS ({_FLAGS}) SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS place FROM e WHERE contains(lower(name), 'e') OR contains(CAST(id AS VARCHAR), 'e') ORDER BY id LIMIT 25 OFFSET 10")
def db_listing(spark, d):
    """The third page of a listing: the limit is the feature."""
    from pyspark.sql import Window as W

    rows = review.listing(_entries(spark, d).withColumn("key", F.col("id")).withColumn("id", F.col("id").cast("string")), "E").select(F.col("key").alias("id"), "name")
    return review.page(rows.withColumn("place", F.row_number().over(W.orderBy("id")).cast("long") - 1), ["id"], 10, 25)


@query("""SELECT count(*) FILTER (event_id % 3 <> 0) AS fingerprinted, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 3 ELSE 0 END) AS BIGINT) AS frames, count(*) FILTER (event_id % 5 <> 0) AS audio, 0::BIGINT AS embeddings FROM events""")
def derived_stats(spark, d):
    k = F.col("event_id")
    gray = F.when(k % 3 == 1, F.create_map(F.lit(0.5), F.lit("x"))).when(k % 3 == 2, F.create_map(F.lit(0.25), F.lit("x"), F.lit(0.75), F.lit("y")))
    e = read(spark, d, "events").select(gray.alias("gray"), F.when(k % 5 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("audio"), F.lit(None).cast("map<double,string>").alias("emb"))
    return cache.derived_stats(e)


@query("""WITH s AS (SELECT o_custkey AS set_id, list_sort(list(o_orderkey)) AS ids FROM orders GROUP BY o_custkey) SELECT set_id, ids FROM s WHERE len(list_filter(ids, lambda i: i % 13 = 0)) = 0""")
def prune_not_a_match(spark, d):
    o = read(spark, d, "orders")
    sets = o.groupBy(F.col("o_custkey").alias("set_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return results.prune_sets(sets, o.filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id")))


@query("SELECT p_partkey AS id, list_filter(string_split(p_type, ' '), lambda t: NOT list_contains(['A', string_split(p_type, ' ')[1]], t)) AS added FROM part")
def tags_added(spark, d):
    t = F.split("p_type", " ")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), results.added(F.array(F.lit("A"), F.get(t, F.lit(0))), t).alias("added"))


@query("""WITH w AS (SELECT event_id AS id, event_id % 3 AS size, event_id % 2 AS mtime, event_id % 4 = 0 AS failed FROM events WHERE event_id % 5 <> 0), i AS (SELECT event_id AS id, event_id % 3 AS size, CASE WHEN event_id % 7 = 0 THEN 9 ELSE event_id % 2 END AS mtime FROM events)
SELECT i.id, w.id IS NOT NULL AS found, w.failed FROM i LEFT JOIN w USING (id, size, mtime)""")
def dense_sidecar(spark, d):
    k, e = F.col("event_id"), read(spark, d, "events")
    dense = e.filter(k % 5 != 0).select(k.alias("id"), (k % 3).alias("size"), (k % 2).alias("mtime"), (k % 4 == 0).alias("failed"))
    items = e.select(k.alias("id"), (k % 3).alias("size"), F.when(k % 7 == 0, 9).otherwise(k % 2).alias("mtime"))
    return store.read_dense(dense, items).select("id", "found", "failed")


@query("""SELECT event_id AS id, event_id % 4 <> 0 AND event_id % 3 <> 0 AS ok FROM events""")
def result_import(spark, d):
    k = F.col("event_id")
    rows = read(spark, d, "events").select(k.alias("n"), F.when(k % 4 == 0, "../x").otherwise("abc").alias("id"), F.lit("name").alias("name"), F.lit("mp4").alias("ext"), (k % 3).alias("group_id"))
    good, bad = store.valid_results(rows)
    return good.select(F.col("n").alias("id"), F.lit(True).alias("ok")).unionByName(bad.select(F.col("n").alias("id"), F.lit(False).alias("ok")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CAST('2020-05-06 07:08:09' AS TIMESTAMP) END AS made, CASE WHEN event_id % 3 = 0 THEN '2020-05-06T07:08:09.000000Z' WHEN event_id % 3 = 1 THEN 'never' END AS tag FROM events""")
def creation_times(spark, d):
    k = F.col("event_id")
    value = F.when(k % 3 == 0, "2020-05-06T07:08:09.000000Z").when(k % 3 == 1, "never")
    text = F.to_json(F.struct(F.struct(F.create_map(F.lit("Creation_Time"), value).alias("tags")).alias("format")))
    text = F.when(k % 3 == 2, '{"format":{}}').otherwise(text)
    e = read(spark, d, "events").select(k.alias("id"), text.alias("t"))
    return e.select("id", media.creation_time(F.col("t")).alias("made"), F.try_element_at(media.container_tags(F.col("t")), F.lit("creation_time")).alias("tag"))


@query("""SELECT doc_id AS id, list_transform(range(0, CAST(least(400, greatest(1, ceil(n_chars / greatest(greatest(least(greatest(n_chars / 60.0, 5.0), 15.0), n_chars / 400.0), 1e-9)))) AS BIGINT)), lambda i: round(i * greatest(least(greatest(n_chars / 60.0, 5.0), 15.0), n_chars / 400.0), 4)) AS times FROM documents""")
def dense_times(spark, d):
    t = display.dense_times(F.col("n_chars").cast("double"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(t, lambda x: F.round(x, 4)).alias("times"))


@query("SELECT page_id AS id, least(CAST(length(html) AS DOUBLE), 500.0) * 0.25 AS second FROM pages")
def sample_seconds(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("id"), display.sample_second(F.length("html").cast("double"), F.lit(0.25), 500).alias("second"))
