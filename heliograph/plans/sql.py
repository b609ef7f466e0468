"""The queries' SQL for DuckDB."""

from heliograph.sources.adapters import catalogue_sql

_CAT = f"cat AS ({catalogue_sql(True)}), px AS (SELECT *, CAST(coalesce(width, 0) AS BIGINT) * coalesce(height, 0) AS pixels FROM cat)"
_MEMBERS = (
    _CAT
    + """, ex AS (SELECT id, content_hash, min(id) OVER (PARTITION BY content_hash) AS gid, count(*) OVER (PARTITION BY content_hash) AS n,
    row_number() OVER (PARTITION BY content_hash ORDER BY pixels DESC, file_size DESC, path) AS rn FROM px),
  mem AS (SELECT gid AS group_id, 'exact' AS kind, id AS image_id, rn = 1 AS is_keeper FROM ex WHERE n > 1
    UNION ALL SELECT 1000000 + id // 50, 'burst', id, id % 50 = 1 FROM cat WHERE id % 50 IN (1, 2))"""
)
_BAND = "CASE WHEN nsfw_score IS NULL THEN 'unchecked' WHEN coalesce(nsfw_score >= {a}, false) OR coalesce(nsfw_tile_mean >= 0.5, false) THEN 'likely' WHEN nsfw_score >= {b} THEN 'unsure' ELSE 'clean' END"
_BALANCED, _EAGER = _BAND.format(a=0.85, b=0.45), _BAND.format(a=0.70, b=0.30)
_DISPLAY = "CASE WHEN coalesce(nsfw_tile_mean >= 0.5 AND nsfw_tile_mean > nsfw_score, false) THEN nsfw_tile_mean ELSE nsfw_score END"
_VIEW = (
    "WITH "
    + _MEMBERS
    + f""", live AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS c, bool_or(is_keeper) OVER (PARTITION BY group_id) AS k, min(image_id) OVER (PARTITION BY group_id) AS f FROM mem),
  dupe AS (SELECT image_id, max(group_id) AS dupe_group, arg_max(kind, group_id) AS dupe_kind, arg_max(CASE WHEN k THEN is_keeper ELSE image_id = f END, group_id) AS is_keeper FROM live WHERE c >= 2 GROUP BY image_id),
  vw AS (SELECT px.*, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS file_name, CAST(year(make_timestamp(exif_taken * 1000000)) AS INT) AS year,
    {_BALANCED} AS band, {_DISPLAY} AS display_score, dupe_group, dupe_kind, is_keeper FROM px LEFT JOIN dupe ON id = image_id) """
)
EXTRA = "coalesce(NOT is_keeper AND dupe_kind IN ('exact', 'variant'), false)"
_SRC = "path >= '/lib/src8/' AND path < '/lib/src80'"

EXACT_GROUPS = "WITH " + _MEMBERS + " SELECT content_hash, id AS image_id, rn = 1 AS is_keeper FROM ex WHERE n > 1"
EXACT_SCOPED = f"WITH {_CAT} SELECT content_hash, id AS image_id FROM cat WHERE {_SRC} AND content_hash IN (SELECT content_hash FROM cat WHERE {_SRC} GROUP BY 1 HAVING count(*) > 1)"
RECLAIMABLE = _VIEW + f"SELECT split_part(path, '/', 3) AS source, count(*) AS extras, CAST(sum(file_size) AS BIGINT) AS bytes FROM vw WHERE {EXTRA} GROUP BY 1"
SCOPE_SCAN = f"WITH {_CAT} SELECT id, path, file_size FROM cat WHERE {_SRC}"
DETECTOR_ROWS = f"WITH {_CAT} SELECT id, path, pixels, file_size AS bytes, exif_taken AS taken, exif_camera AS camera, blur_score AS blur FROM px"
BY_IDS = f"WITH {_CAT} SELECT CAST(pos AS INT) AS pos, id, path FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 1000000000), (4, 11)) t(pos, want) JOIN cat ON id = want"
PATH_INDEX = f"WITH {_CAT} SELECT path, id, pixels, file_size AS bytes FROM px"
PENDING_SCORES = f"WITH {_CAT} SELECT id, path FROM cat WHERE nsfw_score IS NULL OR nsfw_tile_mean IS NULL"
PENDING_OF_IDS = f"WITH {_CAT} SELECT id, path FROM cat WHERE analyzed_at IS NULL AND nsfw_score IS NULL"
PATHS = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '/[^/]*$', '') AS folder, regexp_extract(url, '[^/]*$') AS file_name FROM pages),
  s AS (SELECT *, list_filter(string_split(folder, '/'), lambda x: x <> '') AS seg FROM p)
SELECT page_id, folder, file_name, CASE WHEN len(seg) <= 2 THEN folder ELSE '.../' || array_to_string(seg[-2:], '/') END AS short_folder,
  upper(regexp_extract(file_name, '\.([^.]*)$', 1)) AS extension FROM s"""
LABELS = f"""
WITH {_CAT} SELECT id, CAST(year(make_timestamp(exif_taken * 1000000)) AS INT) AS year, coalesce(strftime(make_timestamp(exif_taken * 1000000), '%Y-%m-%d'), 'unknown date') AS captured,
  width::VARCHAR || ' × ' || height::VARCHAR AS dimensions, pixels, CASE WHEN file_size >= 1000000 THEN printf('%.0f MB', file_size / 1e6) WHEN file_size >= 1000 THEN printf('%.0f KB', file_size / 1e3) ELSE printf('%d bytes', file_size) END AS size,
  coalesce(blur_score <= 100, false) AS soft, CASE WHEN exif_camera IS NULL THEN NULL ELSE exif_camera || ' X' END AS camera FROM px"""
TIME_AGO = """
WITH e AS (SELECT event_id, event_id * event_id % 400000 AS s FROM events)
SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN s / 60 < 1.5 THEN '1 minute ago' WHEN s / 60 < 59.5 THEN round_even(s / 60, 0)::BIGINT || ' minutes ago'
  WHEN s / 3600 < 1.5 THEN '1 hour ago' WHEN s / 3600 < 23.5 THEN round_even(s / 3600, 0)::BIGINT || ' hours ago' WHEN s / 3600 < 36 THEN 'yesterday'
  ELSE round_even(s / 86400, 0)::BIGINT || ' days ago' END AS ago FROM e"""
DECISIONS = f"""
WITH {_CAT}, x AS (SELECT *, coalesce(nsfw_score >= 0.85, false) OR coalesce(nsfw_tile_mean >= 0.5, false) AS explicit FROM cat)
SELECT id, explicit, NOT explicit AND coalesce(nsfw_score >= 0.45, false) AS unsure, {_DISPLAY} AS display, {_BALANCED} AS band, {_EAGER} AS eager_band FROM x"""
EVIDENCE = f"""
WITH {_CAT} SELECT id, CASE WHEN nsfw_score IS NULL THEN 'not scored' WHEN nsfw_tile_mean IS NULL THEN printf('whole frame %.2f (flag 0.85)', nsfw_score)
  WHEN nsfw_tile_mean >= 0.5 THEN printf('tiles %.2f flagged (flag 0.50), whole frame %.2f', nsfw_tile_mean, nsfw_score)
  ELSE printf('whole frame %.2f (flag 0.85), tiles %.2f (flag 0.50)', nsfw_score, nsfw_tile_mean) END AS evidence FROM cat"""
TILES = f"""
WITH {_CAT}, t AS (SELECT unnest(range(0, 9)) AS tile), r AS (SELECT id, tile, width, height - 60 AS height, [0.0::DOUBLE, 0.3, 0.6][tile % 3 + 1] AS x, [0.0::DOUBLE, 0.3, 0.6][tile // 3 + 1] AS y FROM cat, t)
SELECT id, tile::INT AS tile, floor(x * width)::INT AS left, floor(y * height)::INT AS top, floor(0.4::DOUBLE * width)::INT AS w, floor(0.4::DOUBLE * height)::INT AS h FROM r WHERE floor(0.4::DOUBLE * width) >= 32 AND floor(0.4::DOUBLE * height) >= 32"""
BAND_COUNTS = _VIEW + "SELECT band, count(*) AS n FROM vw GROUP BY band"
FACET = _VIEW + "SELECT id, folder, band, dupe_kind FROM vw WHERE {where}"
SORT = _VIEW + "SELECT id AS image_id, row_number() OVER (ORDER BY {order}) AS place FROM vw"
SEARCH = _VIEW + "SELECT id, file_name, folder FROM vw WHERE contains(upper(file_name), 'SRC1/E') OR contains(upper(folder), 'SRC1/E') ORDER BY upper(file_name), id LIMIT 8"
PAGE = _VIEW + "SELECT id, blur_score FROM vw ORDER BY blur_score DESC NULLS LAST, id LIMIT 25 OFFSET 40"
TALLY = _VIEW + " UNION ALL ".join(
    f"SELECT '{name}' AS scope, count(*) AS n, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM vw WHERE {where}"
    for name, where in (("all_shown", "true"), ("likely_explicit", "band = 'likely'"), ("not_sure", "band = 'unsure'"), ("duplicate_extras", EXTRA), ("duplicate_keepers", "coalesce(is_keeper, false)"))
)
SUMMARY = _VIEW + f"""SELECT count(*) AS photos, count_if({EXTRA})::BIGINT AS extras, CAST(coalesce(sum(CASE WHEN {EXTRA} THEN file_size END), 0) AS BIGINT) AS reclaimable, count_if(coalesce(is_keeper, false))::BIGINT AS keepers,
  count_if(coalesce(dupe_kind = 'burst', false))::BIGINT AS bursts, count_if(band = 'unchecked')::BIGINT AS unchecked, count_if(coalesce(blur_score <= 100, false))::BIGINT AS soft,
  bool_or(coalesce(NOT is_keeper AND dupe_kind = 'burst', false)) AS burst_only_extras FROM vw"""
FOLDERS = _VIEW + "SELECT DISTINCT folder FROM vw"
YEARS = _VIEW + "SELECT DISTINCT year FROM vw WHERE year IS NOT NULL"
DIFFERENCES = _VIEW + """, t AS (SELECT *, max(width) OVER g AS m1, max(file_size) OVER g AS m2, max(blur_score) OVER g AS m3 FROM vw WHERE dupe_group IS NOT NULL WINDOW g AS (PARTITION BY dupe_group)),
  a AS (SELECT dupe_group AS dg, count(DISTINCT coalesce(width::VARCHAR, '')) > 1 AS width_differs, count(DISTINCT coalesce(file_size::VARCHAR, '')) > 1 AS file_size_differs, count(DISTINCT coalesce(blur_score::VARCHAR, '')) > 1 AS blur_score_differs,
    count_if(width = m1) AS c1, count_if(file_size = m2) AS c2, count_if(blur_score = m3) AS c3 FROM t GROUP BY 1)
SELECT dupe_group, id AS image_id, width_differs, coalesce(width = m1 AND c1 = 1 AND width <> 0, false) AS width_best, file_size_differs, coalesce(file_size = m2 AND c2 = 1 AND file_size <> 0, false) AS file_size_best,
  blur_score_differs, coalesce(blur_score = m3 AND c3 = 1 AND blur_score <> 0, false) AS blur_score_best FROM t JOIN a ON dg = dupe_group"""
MEMBERS_BY_PATH = _VIEW + "SELECT dupe_group, string_agg(id::VARCHAR, ',' ORDER BY path) AS ids FROM vw WHERE dupe_group IS NOT NULL GROUP BY dupe_group"
CODEC = "SELECT (doc_id // 64)::VARCHAR AS batch, doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha256, NULL::VARCHAR AS error FROM documents"
LIVE = "WITH " + _MEMBERS + """, p AS (SELECT mem.* FROM mem JOIN cat ON image_id = id WHERE dupe_checked_at IS NOT NULL), l AS (SELECT *, count(*) OVER g AS c, bool_or(is_keeper) OVER g AS k, min(image_id) OVER g AS f FROM p WINDOW g AS (PARTITION BY group_id))
SELECT group_id, kind, image_id, CASE WHEN k THEN is_keeper ELSE image_id = f END AS is_keeper FROM l WHERE c >= 2"""
INVERT = _VIEW + "SELECT id FROM vw WHERE coalesce(blur_score >= 100, false) <> (band IN ('likely', 'unsure'))"
SELECT_EXTRAS = _VIEW + f"SELECT id FROM vw WHERE {EXTRA}"
REJECTS = f"WITH {_CAT} SELECT count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM cat WHERE dupe_checked_kinds <> 7"
_STEPS = "count_if(analyzed_at IS NOT NULL)::BIGINT AS analyzed, count_if(blur_score IS NOT NULL)::BIGINT AS blur, count_if(exif_taken IS NOT NULL)::BIGINT AS dated, count_if(nsfw_score IS NOT NULL)::BIGINT AS nsfw, count_if(dupe_checked_at IS NOT NULL AND dupe_checked_kinds & 5 = 5)::BIGINT AS deduped, count_if(dupe_group IS NOT NULL)::BIGINT AS in_dupe_group"
ROLLUP = _VIEW + f""", e AS (SELECT vw.*, unnest(list_transform(range(2, len(string_split(folder, '/')) + 1), lambda n: array_to_string(string_split(folder, '/')[:n], '/'))) AS up FROM vw)
SELECT up AS path, count_if(folder = up)::BIGINT AS direct_count, count(*) AS total_count, {_STEPS} FROM e GROUP BY up"""
ROLLUP_PAGES = """
WITH f AS (SELECT regexp_replace(url, '/[^/]*$', '') AS folder FROM pages),
  e AS (SELECT unnest(list_transform(range(1, len(string_split(folder, '/')) + 1), lambda n: array_to_string(string_split(folder, '/')[:n], '/'))) AS path FROM f)
SELECT path, count(*) AS pages FROM e WHERE path <> '' GROUP BY path"""


def _turned(turn: int, y: int, x: int, n: int = 8) -> int:
    for _ in range(turn):
        y, x = n - 1 - x, y
    return y * n + x + 1


def _bits(turn: int) -> str:
    cell = [[f"embedding[{_turned(turn, y, x)}]" for x in range(8)] for y in range(8)]
    return " || ".join(f"CASE WHEN {cell[y][x + 1]} > {cell[y][x]} THEN '1' ELSE '0' END" for y in range(8) for x in range(7))


PAIRS = f"""
WITH s AS (SELECT vec_id AS id, {', '.join(f'{_bits(t)} AS s{t}' for t in range(4))} FROM embeddings),
  d AS (SELECT x.id AS a, y.id AS b, CAST(least({', '.join(f'hamming(x.s{t}, y.s0)' for t in range(4))}) AS INT) AS distance FROM s x JOIN s y ON x.id < y.id)
SELECT a, b, distance FROM d WHERE distance <= 12"""
_NEAR = PAIRS.partition("\n  d AS")[0] + f"""
  near AS (SELECT * FROM (SELECT x.id AS x, y.id AS y, CAST(least({', '.join(f'hamming(x.s{t}, y.s0)' for t in range(4))}) AS INT) AS d FROM s x JOIN s y ON x.id <> y.id) WHERE d <= 12),
  p AS (SELECT x AS a, y AS b, d FROM near WHERE x < y)"""
CLASSES = _NEAR.replace("WITH s", "WITH t0").replace("FROM embeddings)", "FROM embeddings), s AS (SELECT min(id) AS id, s0, s1, s2, s3 FROM t0 GROUP BY s0, s1, s2, s3)") + """
SELECT t0.id, s.id AS class_id, (SELECT count(DISTINCT CASE WHEN x = s.id THEN y ELSE x END) FROM near WHERE x = s.id OR y = s.id)::BIGINT AS links FROM t0 JOIN s USING (s0, s1, s2, s3)"""
#: The sequential procedure: one step takes the next pair of every component. st: rows and their groups so far; ws: pairs within.
CLIQUES = _NEAR.replace("WITH s", "WITH RECURSIVE s") + """,
  e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
  reach AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.node),
  comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
  q AS (SELECT root, list({'a': a, 'b': b} ORDER BY d, a, b) AS ps FROM p JOIN comp ON a = node GROUP BY root),
  w AS (SELECT root, list(x * 1000000000 + y) AS ws FROM near JOIN comp ON x = node GROUP BY root),
  run AS (
    SELECT root, ps, ws, 1 AS k, []::STRUCT(g BIGINT, i BIGINT)[] AS st FROM q JOIN w USING (root)
    UNION ALL
    SELECT root, ps, ws, k + 1, CASE
      WHEN ga IS NULL AND gb IS NULL THEN list_concat(st, [{'g': k::BIGINT, 'i': a}, {'g': k::BIGINT, 'i': b}])
      WHEN ga IS NULL THEN CASE WHEN list_has_all(ws, list_transform(mb, lambda m: m * 1000000000 + a)) THEN list_append(st, {'g': gb, 'i': a}) ELSE st END
      WHEN gb IS NULL THEN CASE WHEN list_has_all(ws, list_transform(ma, lambda m: m * 1000000000 + b)) THEN list_append(st, {'g': ga, 'i': b}) ELSE st END
      WHEN ga <> gb AND list_has_all(ws, flatten(list_transform(ma, lambda m: list_transform(mb, lambda n: m * 1000000000 + n)))) THEN list_transform(st, lambda t: {'g': CASE WHEN t.g = gb THEN ga ELSE t.g END, 'i': t.i})
      ELSE st END
    FROM (SELECT *, list_transform(list_filter(st, lambda t: t.g = ga), lambda t: t.i) AS ma, list_transform(list_filter(st, lambda t: t.g = gb), lambda t: t.i) AS mb
      FROM (SELECT *, list_filter(st, lambda t: t.i = a)[1].g AS ga, list_filter(st, lambda t: t.i = b)[1].g AS gb
        FROM (SELECT *, ps[k].a AS a, ps[k].b AS b FROM run WHERE k <= len(ps))))),
  last AS (SELECT root, unnest(st, max_depth := 2) FROM run WHERE k = len(ps) + 1)
SELECT min(i) OVER (PARTITION BY root, g) AS key, i AS image_id FROM last"""
ORDER_PAIRS = """
SELECT x.o_orderkey AS a, y.o_orderkey AS b, (CASE WHEN x.o_orderkey % 64 <> y.o_orderkey % 64 THEN 2 ELSE 0 END + CASE WHEN x.o_orderkey % 61 <> y.o_orderkey % 61 THEN 2 ELSE 0 END)::INT AS distance
FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey"""
BURSTS = """
WITH e AS (SELECT event_id AS id, user_id, floor(epoch(ts))::BIGINT AS t, floor(value * 1000)::BIGINT AS w FROM events)
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.w, y.w)) AS INT) AS distance FROM e x JOIN e y ON x.user_id = y.user_id AND (y.t > x.t OR (y.t = x.t AND y.id > x.id)) AND y.t - x.t <= 600"""
RECONCILE = f"""
WITH {_CAT}, m AS (SELECT 'exact' AS kind, content_hash AS key, id FROM cat UNION ALL SELECT 'variant', split_part(path, '/', 4) || ':' || file_size, id FROM cat),
  k AS (SELECT *, count(*) OVER (PARTITION BY kind, key) AS n, min(id) OVER (PARTITION BY kind, key) * 2 + (kind = 'variant')::INT AS gid FROM m),
  g AS (SELECT * FROM k WHERE n > 1),
  c AS (SELECT w.gid FROM g w JOIN g s ON w.id = s.id AND w.kind = 'variant' AND s.kind = 'exact' GROUP BY w.gid, s.gid, w.n HAVING count(*) = w.n)
SELECT DISTINCT gid AS id, kind FROM g WHERE gid NOT IN (SELECT gid FROM c)"""
BLUR = f"""
WITH l AS (SELECT vec_id, {', '.join(f"CAST(embedding[{8 * y + x + 1 - 8}] + embedding[{8 * y + x + 1 + 8}] + embedding[{8 * y + x}] + embedding[{8 * y + x + 2}] - 4::FLOAT * embedding[{8 * y + x + 1}] AS DOUBLE) AS l{y}_{x}" for y in range(1, 7) for x in range(1, 7))} FROM embeddings)
SELECT vec_id, round(({' + '.join(f'l{y}_{x} * l{y}_{x}' for y in range(1, 7) for x in range(1, 7))}) / 64 - pow(({' + '.join(f'l{y}_{x}' for y in range(1, 7) for x in range(1, 7))}) / 64, 2), 4) AS blur FROM l"""
PROBE = f"WITH {_CAT} SELECT path, CASE WHEN exif_camera IS NULL THEN 'new' WHEN blur_score IS NULL OR analyzed_at IS NULL THEN 'changed' ELSE 'cached' END AS status FROM cat"
UPSERT = f"""
WITH {_CAT}, old AS (SELECT * FROM cat WHERE exif_camera IS NOT NULL), top AS (SELECT max(id) AS m FROM old)
SELECT id, path, file_size, nsfw_tile_mean, dupe_checked_at, dupe_checked_kinds FROM old WHERE blur_score IS NOT NULL
UNION ALL SELECT id, path, file_size + 1, NULL, NULL, 0 FROM old WHERE blur_score IS NULL
UNION ALL SELECT m + row_number() OVER (ORDER BY path), path, file_size + (blur_score IS NULL)::INT, NULL, NULL, 0 FROM cat, top WHERE exif_camera IS NULL"""
PRUNE = f"WITH {_CAT} SELECT id, path FROM cat WHERE NOT ({_SRC}) OR blur_score IS NOT NULL"
MARK = f"WITH {_CAT} SELECT id, CASE WHEN {_SRC} THEN 1800000000 ELSE dupe_checked_at END::BIGINT AS dupe_checked_at, CASE WHEN {_SRC} THEN 7 ELSE dupe_checked_kinds END::INT AS dupe_checked_kinds FROM cat"
UPDATED = f"WITH {_CAT} SELECT id, CASE WHEN analyzed_at IS NULL THEN 0.33::DOUBLE ELSE nsfw_score END AS nsfw_score FROM cat"
CLEAR_KIND = "WITH " + _MEMBERS + f", a AS (SELECT group_id, kind, bool_and({_SRC}) AS inside FROM mem JOIN cat ON id = image_id GROUP BY 1, 2) SELECT group_id AS id, kind FROM a WHERE NOT (kind = 'exact' AND inside)"
TOGGLE = "WITH " + _MEMBERS + """, k AS (SELECT *, count_if(is_keeper) OVER (PARTITION BY group_id) AS n, min(image_id) OVER (PARTITION BY group_id) AS f FROM mem)
SELECT group_id, image_id, CASE WHEN image_id = f AND NOT (is_keeper AND n <= 1) THEN NOT is_keeper ELSE is_keeper END AS is_keeper FROM k"""
FAILURES = f"""
WITH {_CAT}, r AS (SELECT path, CASE WHEN exif_taken IS NULL THEN 'unreadable' ELSE 'not a picture' END AS reason FROM cat WHERE exif_taken IS NULL OR blur_score IS NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS k FROM r)
SELECT reason, count(*) AS n, string_agg(path, '|' ORDER BY path) FILTER (WHERE k <= 3) AS paths, greatest(count(*) - 3, 0) AS more FROM k GROUP BY reason"""
UNSUPPORTED = f"WITH {_CAT} SELECT CASE id % 4 WHEN 0 THEN 'HEIC' WHEN 1 THEN 'CR2' ELSE 'NEF' END AS extension, count(*) AS n FROM cat WHERE id % 4 <> 2 GROUP BY 1"
_PLANNED = """
  e AS (SELECT id, content_hash, (id % 100)::VARCHAR AS stem, path, {dir} AS dir FROM cat),
  f AS (SELECT *, min(id) OVER (PARTITION BY dir, stem, content_hash) AS first FROM e),
  g AS (SELECT *, dense_rank() OVER (PARTITION BY dir, stem ORDER BY first) AS slot FROM f),
  p AS (SELECT id AS image_id, dir || '/' || stem || CASE WHEN slot = 1 THEN '' ELSE ' (' || slot || ')' END || '.txt' AS dest_path, CASE WHEN id = first THEN 'copy' ELSE 'skipped' END AS status, content_hash FROM g)"""
_FLAT = f"WITH {_CAT}, " + _PLANNED.format(dir="'/out'")
EXPORT_FLAT = _FLAT + " SELECT image_id, dest_path, status FROM p"
EXPORT_DATE = f"WITH {_CAT}, " + _PLANNED.format(dir="'/out/' || coalesce(strftime(make_timestamp(exif_taken * 1000000), '%Y/%Y-%m'), 'undated')") + " SELECT image_id, dest_path, status FROM p"
EXPORT_MIRROR = f"WITH {_CAT}, " + _PLANNED.format(dir=f"CASE WHEN {_SRC} THEN '/out/' || split_part(path, '/', 4) ELSE '/out' END") + " SELECT image_id, dest_path, status FROM p"
PREFLIGHT = f"""
WITH {_CAT}, s AS (SELECT DISTINCT '/out/' || coalesce(strftime(make_timestamp(exif_taken * 1000000), '%Y/%Y-%m'), 'undated') AS d FROM (SELECT * FROM cat ORDER BY id LIMIT 5))
SELECT count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, sum(file_size) < 1000000 AS enough, (SELECT string_agg(d, '|' ORDER BY d) FROM s) AS samples FROM cat"""
_JOURNAL = _FLAT + """, j AS (SELECT image_id, dest_path, content_hash, CASE WHEN status = 'skipped' THEN 'skipped' WHEN content_hash[1] IN ('0', '1') THEN 'failed' ELSE 'verified' END AS status FROM p)"""
RUN_STATUS = _JOURNAL + " SELECT 1::BIGINT AS run_id, count_if(status = 'verified')::BIGINT AS exported, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'failed')::BIGINT AS failed, CASE WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'done' END AS status FROM j"
REMAINING = _JOURNAL + " SELECT image_id, dest_path FROM j WHERE status = 'failed'"
MANIFEST = _JOURNAL + """ SELECT image_id, status, '"' || CASE WHEN exif_taken IS NULL THEN '' ELSE cat.path END || ',x"' AS source, dest_path AS destination,
  CASE WHEN status = 'skipped' THEN 'identical file exists' WHEN status = 'verified' THEN '' WHEN j.content_hash[1] = '0' THEN 'missing' ELSE 'differs' END AS detail FROM j JOIN cat ON id = image_id"""
_LOG = "WITH l AS (SELECT event_id AS id, 'b' || user_id % 20 AS batch_id, floor(epoch(ts))::BIGINT AS ts_utc, (event_id % 3 = 0)::INT AS restored FROM events)"
UNDO_BATCHES = _LOG + " SELECT batch_id, min(ts_utc) AS ts_utc, count(*) AS total, CAST(sum(restored) AS BIGINT) AS restored FROM l GROUP BY batch_id"
UNDO_ITEMS = _LOG + " SELECT batch_id, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS place FROM l) WHERE place <= 8"
ACTIVITY = "SELECT floor(epoch(date_trunc('hour', ts)))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ETA = """
WITH r AS (SELECT user_id AS job, event_id, floor(epoch(ts) * 1000)::BIGINT AS ms FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ms, event_id) AS done FROM r),
  w AS (SELECT *, first_value(ms) OVER q AS m0, min(done) OVER q AS d0 FROM d WINDOW q AS (PARTITION BY job ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN ms > m0 AND done > d0 AND done < 10000 THEN round((10000 - done) / ((done - d0) / ((ms - m0) / 1000)), 0) END AS eta FROM w"""
PRICING = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"
ORDER_YEARS = "SELECT c_mktsegment, CAST(year(o_orderdate) AS INT) AS year, count(*) AS orders, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
PICTURES = f"""
WITH {_CAT}, f AS (SELECT *, CAST(file_size % 8 + 1 AS INT) AS orientation FROM cat)
SELECT path, ['JPEG', 'PNG', 'WEBP'][length(path) % 3 + 1] AS format, CASE WHEN orientation > 4 THEN height ELSE width END AS width, CASE WHEN orientation > 4 THEN width ELSE height END AS height,
  orientation, exif_taken, CASE WHEN exif_camera IS NULL THEN NULL WHEN file_size % 2 = 0 THEN exif_camera || ' Z1' ELSE upper(exif_camera) || ' Z1' END AS exif_camera FROM f"""
RECYCLED = f"""
WITH {_MEMBERS}, gone AS (SELECT id FROM ex WHERE n > 1 AND rn > 1 AND content_hash IS NOT NULL)
SELECT path, CASE WHEN g.id IS NULL THEN NULL WHEN file_size % 2 = 0 THEN 'restored' ELSE 'recycled' END AS status, g.id IS NULL AS listed,
  CASE WHEN g.id IS NULL OR file_size % 2 = 0 THEN sha256(coalesce(text, '')) END AS sha256 FROM cat JOIN documents ON id = doc_id LEFT JOIN gone g ON cat.id = g.id"""
