"""Page layout, form fields and uploaded files over tables derived from conversations, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions import form_fields as FF
from casemesh.functions import geometry as G
from casemesh.functions import patterns as P
from casemesh.functions import text as X
from casemesh.operators import layout as L
from casemesh.plans.listing_queries import quoted
from casemesh.plans.registry import query
from casemesh.sources import blobs as B

OVERLAP = ("greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) "
           "* greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))")
PAIR_AREAS = "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)"


@query("box_geometry", f"""
SELECT a.doc_id, a.page, a.box_no, (a.x2 - a.x1) * (a.y2 - a.y1) AS area,
  round({OVERLAP} / ({PAIR_AREAS} - {OVERLAP}), 6) AS iou,
  round(({OVERLAP}) / ((b.x2 - b.x1) * (b.y2 - b.y1)), 6) AS contained,
  least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.5 * least(a.y2 - a.y1, b.y2 - b.y1) AS same_line
FROM m_boxes a JOIN m_boxes b ON b.doc_id = a.doc_id AND b.page = a.page AND b.box_no >> 1 = a.box_no >> 1
  AND a.box_no < b.box_no WHERE b.x2 > b.x1""")
def _(m):
    boxes = m.m_boxes
    first = boxes.select(*(F.col(c).alias(f"a_{c}") for c in boxes.columns))
    again = boxes.filter("x2 > x1").select(*(F.col(c).alias(f"b_{c}") for c in boxes.columns))
    both = first.join(again, (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("a_page") == F.col("b_page"))
                      & (F.shiftright("a_box_no", 1) == F.shiftright("b_box_no", 1))
                      & (F.col("a_box_no") < F.col("b_box_no")))
    return both.select(
        F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_box_no").alias("box_no"),
        G.area("a_").alias("area"), F.round(G.iou("a_", "b_"), 6).alias("iou"),
        F.round(G.containment("b_", "a_"), 6).alias("contained"), G.same_line("a_", "b_").alias("same_line"))


@query("box_pairs", f"""
SELECT a.doc_id, a.page, a.box_no, b.box_no AS other_box_no, round({OVERLAP} / ({PAIR_AREAS} - {OVERLAP}), 6) AS iou,
  round(({OVERLAP}) / ((a.x2 - a.x1) * (a.y2 - a.y1)), 6) AS inside_other
FROM m_boxes a JOIN m_boxes b ON b.doc_id = a.doc_id AND b.page = a.page AND b.box_no > a.box_no
WHERE a.x2 > a.x1 AND b.x2 > b.x1 AND {OVERLAP} / ({PAIR_AREAS} - {OVERLAP}) > {K.NMS_IOU}""")
def _(m):
    return L.box_pairs(m.m_boxes)


DEV = "[ऀ-॥॰-ॿ]"


# Suppression by walking each page in rank order; rows by walking the survivors top to bottom.
def nms_sql(boxes: str) -> str:
    return f"""solid AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY doc_id, page
    ORDER BY regexp_matches(text, '{DEV}') DESC, confidence DESC, (x2 - x1) * (y2 - y1) DESC, box_no) AS i FROM {boxes} WHERE x2 > x1 AND y2 > y1),
 walk AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a INT, b INT, c INT, d INT)[]) AS kept,
     false AS free, 0 AS box_no FROM (SELECT DISTINCT doc_id, page FROM solid)
   UNION ALL SELECT doc_id, page, i, CASE WHEN free THEN list_append(kept, {{'a': x1, 'b': y1, 'c': x2, 'd': y2}}) ELSE kept END,
     free, box_no
   FROM (SELECT s.*, w.kept, len(list_filter(w.kept, lambda k:
       greatest(0, least(k.c, s.x2) - greatest(k.a, s.x1)) * greatest(0, least(k.d, s.y2) - greatest(k.b, s.y1))
         / (s.area + (k.c - k.a) * (k.d - k.b) - greatest(0, least(k.c, s.x2) - greatest(k.a, s.x1))
         * greatest(0, least(k.d, s.y2) - greatest(k.b, s.y1))) > {K.NMS_IOU}
       OR greatest(0, least(k.c, s.x2) - greatest(k.a, s.x1)) * greatest(0, least(k.d, s.y2) - greatest(k.b, s.y1))
         / s.area > {K.NMS_CONTAINMENT})) = 0 AS free
     FROM walk w JOIN solid s ON s.doc_id = w.doc_id AND s.page = w.page AND s.i = w.i + 1)),
 nms AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY w.i) AS INT) AS rank
   FROM {boxes} b JOIN walk w USING (doc_id, page, box_no) WHERE w.free)"""


NMS = nms_sql("m_boxes")


@query("boxes_suppressed", f"WITH {NMS} SELECT * FROM nms")
def _(m):
    return L.nms(m.m_boxes)


BARE = "lower(regexp_replace({}, '[\\s\\p{{Z}}]', '', 'g'))"
FRAGMENTS = """ SELECT * FROM {t} a WHERE NOT EXISTS (SELECT 1 FROM {t} b WHERE b.doc_id = a.doc_id AND b.page = a.page
   AND length({bb}) > length({ab}) AND contains({bb}, {ab}) AND length({ab}) > 0
   AND ({overlap}) / ((a.x2 - a.x1) * (a.y2 - a.y1)) > 0.5 AND a.x2 > a.x1)"""


def fragments(table: str) -> str:
    return FRAGMENTS.format(t=table, ab=BARE.format("a.text"), bb=BARE.format("b.text"), overlap=OVERLAP)


@query("fragments_dropped", fragments("m_boxes"))
def _(m):
    return L.drop_fragments(m.m_boxes)


def rows_sql(boxes: str) -> str:
    return f"""{nms_sql(boxes)}, clean AS ({fragments("nms")}),
 sorted AS (SELECT *, (y1 + y2) / 2.0 AS cy, row_number() OVER (PARTITION BY doc_id, page
     ORDER BY (y1 + y2) / 2.0, x1, rank) AS i FROM clean),
 grow AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s DOUBLE, n INT)[]) AS rs, CAST(0 AS BIGINT) AS hit,
     0 AS box_no FROM (SELECT DISTINCT doc_id, page FROM sorted)
   UNION ALL SELECT doc_id, page, i, CASE WHEN hitpos IS NULL OR hitpos = 0 THEN list_append(rs, {{'s': cy, 'n': 1}})
       ELSE list_transform(rs, lambda r, k: CASE WHEN k = hitpos THEN {{'s': r.s + cy, 'n': r.n + 1}} ELSE r END) END,
     CASE WHEN hitpos IS NULL OR hitpos = 0 THEN len(rs) + 1 ELSE hitpos END, box_no
   FROM (SELECT s.*, g.rs, list_position(list_transform(g.rs, lambda r: abs(r.s / r.n - s.cy) <= {K.ROW_TOLERANCE}), true) AS hitpos
     FROM grow g JOIN sorted s ON s.doc_id = g.doc_id AND s.page = g.page AND s.i = g.i + 1)),
 placed AS (SELECT s.*, g.hit FROM sorted s JOIN grow g USING (doc_id, page, i)),
 means AS (SELECT doc_id, page, hit, avg(cy) AS mean FROM placed GROUP BY 1, 2, 3),
 rowed AS (SELECT doc_id, page, hit, round_even(mean, 2) AS center_y,
     CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY mean, hit) AS INT) AS row_index FROM means),
 cells AS (SELECT p.*, r.row_index, r.center_y FROM placed p JOIN rowed r USING (doc_id, page, hit)),
 joined AS (SELECT *, lag(x2) OVER w AS prev FROM cells WINDOW w AS (PARTITION BY doc_id, page, row_index ORDER BY x1, cy, rank)),
 lines AS (SELECT doc_id, page, row_index, center_y, CAST(count(*) AS INT) AS cells,
     string_agg(CASE WHEN prev IS NULL THEN '' WHEN x1 - prev > {K.COLUMN_GAP} THEN '   |   ' ELSE ' ' END || text, ''
       ORDER BY x1, cy, rank) AS text FROM joined GROUP BY 1, 2, 3, 4)"""


ROWS = rows_sql("m_boxes")


@query("layout_rows", f"""WITH {ROWS} SELECT doc_id, page, box_no, row_index, center_y FROM cells""")
def _(m):
    kept = L.drop_fragments(L.nms(m.m_boxes))
    return L.cluster_rows(kept, pos="rank").select("doc_id", "page", "box_no", "row_index", "center_y")


@query("layout_lines", f"WITH {ROWS} SELECT * FROM lines")
def _(m):
    return L.page_rows(m.m_boxes)


# Every fourth document has a further page on which nothing was recognised.
LISTED = """listed AS (SELECT DISTINCT doc_id, page FROM m_boxes
   UNION SELECT DISTINCT doc_id, 99 FROM m_boxes WHERE doc_id % 4 = 0),
 pg AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY row_index) AS text, count(*) AS row_count,
    sum(cells) AS token_count FROM lines GROUP BY 1, 2)"""


def _listed(m):
    blank = m.m_boxes.filter("doc_id % 4 = 0").select("doc_id", F.lit(99).alias("page"))
    return m.m_boxes.select("doc_id", "page").unionByName(blank)


@query("layout_documents", f"""
WITH {ROWS}, {LISTED}
SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page), '') AS text,
  CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS token_count,
  count(*) AS page_count FROM listed LEFT JOIN pg USING (doc_id, page) GROUP BY doc_id""")
def _(m):
    docs = L.assemble_document(L.reconstruct(m.m_boxes, listed=_listed(m)))
    return docs.select("doc_id", "text", "row_count", "token_count", "page_count")


WORD_KIND = f"""SELECT *, CASE WHEN confidence >= 0.5 THEN 'trusted' WHEN confidence >= 0.2 AND
    regexp_matches(text, '[()]') THEN 'gloss' ELSE 'weak' END AS kind
  FROM (SELECT *, length(text) - length(regexp_replace(text, '{DEV}', '', 'g')) AS dev,
    length(text) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}ऀ-॥॰-ॿ]', '', 'g')) AS counted FROM m_script_boxes)
  WHERE dev >= 2 AND dev / counted >= 0.6"""


@query("script_words", f"SELECT doc_id, page, box_no, text, confidence, kind FROM ({WORD_KIND})")
def _(m):
    return L.select_words(m.m_script_boxes).select("doc_id", "page", "box_no", "text", "confidence", "kind")


@query("bilingual_pages", f"""
SELECT doc_id, page, count(*) FILTER (kind = 'trusted') AS trusted_words FROM ({WORD_KIND}) GROUP BY 1, 2
HAVING count(*) FILTER (kind = 'trusted') >= {K.BILINGUAL_WORDS}""")
def _(m):
    return L.is_bilingual(L.select_words(m.m_script_boxes))


# Gloss repair by walking each page's boxes with brackets, which take words; then every box with the words it had left.
BRACKET = r"\([^()]*\)"
UNDER = "list_filter({l}, lambda x: least(x.b, {k}.g2) - greatest(x.a, {k}.g1) > 0.5 * (x.b - x.a))"


def _covered(words: str, left: str, right: str) -> str:
    """Share of a stretch under words sorted by their starts: each adds what reaches beyond all before it."""
    return (f"(coalesce(list_sum(list_transform({words}, lambda x, i: greatest(0, least(x.b, {right}) - greatest(x.a, {left}, "
            f"coalesce(list_max(list_transform(({words})[1:i - 1], lambda y: y.b)), -1e9))))), 0) / ({right} - {left}))")


def glosses_sql(boxes: str) -> str:
    under = UNDER.format
    taking = (f"NOT k.dev AND len({under(l='free', k='k')}) > 0 AND {_covered('free', 'k.g1', 'k.g2')} >= 0.6::DOUBLE")
    whole = f"confidence < 0.85 AND len(ws) > 0 AND {_covered('free', 'x1', 'x2')} >= 0.6::DOUBLE"
    nearby = under(l="list_filter(ws, lambda x: NOT x.s OR list_contains(list_transform(free, lambda f: f.w), x.w))", k="k")
    return f"""words AS ({WORD_KIND}),
 near AS (SELECT l.doc_id, l.page, l.box_no, list({{'w': w.box_no, 'a': w.x1, 'b': w.x2, 't': w.text, 's': w.confidence >= 0.5}}
     ORDER BY w.x1, w.box_no) AS ws FROM {boxes} l JOIN words w ON w.doc_id = l.doc_id AND w.page = l.page
     AND least(l.y2, w.y2) - greatest(l.y1, w.y1) > 0.5 * least(l.y2 - l.y1, w.y2 - w.y1) WHERE l.x2 > l.x1 GROUP BY ALL),
 cut AS (SELECT *, regexp_extract_all(text, '{BRACKET}') AS ms, string_split_regex(text, '{BRACKET}') AS ps FROM {boxes}),
 box AS (SELECT c.*, coalesce(ws, []) AS ws, list_transform(range(1, len(ms) + 1), lambda i: {{
     'g1': x1 + (x2 - x1) * (list_sum(list_transform(ps[1:i], lambda p: length(p)))
       + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0)) / length(text)::DOUBLE,
     'g2': x1 + (x2 - x1) * (list_sum(list_transform(ps[1:i], lambda p: length(p)))
       + list_sum(list_transform(ms[1:i], lambda p: length(p)))) / length(text)::DOUBLE,
     'dev': regexp_matches(ms[i], '{DEV}')}}) AS ks FROM cut c LEFT JOIN near USING (doc_id, page, box_no)),
 turns AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY box_no) AS n FROM box WHERE len(ks) > 0 AND len(ws) > 0),
 taking AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(w INT, b INT)[]) AS taken
     FROM (SELECT DISTINCT doc_id, page FROM turns)
   UNION ALL SELECT doc_id, page, n, CASE WHEN {whole} THEN taken ELSE list_concat(taken, flatten(list_transform(
       list_filter(ks, lambda k: {taking}),
       lambda k: list_transform({under(l='free', k='k')}, lambda f: {{'w': f.w, 'b': box_no}})))) END
   FROM (SELECT t.*, k.taken, list_filter(t.ws, lambda x: x.s AND NOT list_contains(list_transform(k.taken, lambda t: t.w), x.w)) AS free
     FROM taking k JOIN turns t ON t.doc_id = k.doc_id AND t.page = k.page AND t.n = k.n + 1)),
 ends AS (SELECT doc_id, page, arg_max(taken, n) AS taken FROM taking GROUP BY 1, 2),
 left_free AS (SELECT b.*, list_filter(ws, lambda x: x.s AND NOT list_contains(list_transform(list_filter(coalesce(e.taken, []),
     lambda t: t.b < box_no), lambda t: t.w), x.w)) AS free FROM box b LEFT JOIN ends e USING (doc_id, page)),
 judged AS (SELECT *, {whole} AS whole FROM left_free),
 brackets AS (SELECT doc_id, page, box_no, free, ws, ms, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM judged WHERE NOT whole),
 said AS (SELECT doc_id, page, box_no, i, ms[i] AS old, {taking} AS filled, len(list_filter({nearby}, lambda x: starts_with(ltrim(x.t), '('))) > 0
     AND NOT k.dev AND {_covered(nearby, 'k.g1', 'k.g2')} >= 0.6::DOUBLE AS gone, list_filter(list_transform({under(l='free', k='k')},
     lambda x: trim(replace(replace(x.t, '(', ''), ')', ''), ' :')), lambda y: y <> '') AS told FROM brackets),
 put AS (SELECT doc_id, page, box_no, list(CASE WHEN filled THEN concat('(', array_to_string(list_filter(told,
     lambda y, j: j = 1 OR y <> told[j - 1]), ' '), ')') WHEN gone THEN '' ELSE old END ORDER BY i) AS new FROM said GROUP BY ALL),
 texts AS (SELECT j.*, new, array_to_string(list_transform(ps, lambda p, i: concat(p, new[i])), '') AS made FROM judged j
   LEFT JOIN put USING (doc_id, page, box_no) WHERE NOT whole),
 kept AS (SELECT 'latin' AS engine, doc_id, page, box_no, CASE WHEN new IS NULL OR made = text THEN text ELSE trim(regexp_replace(
     regexp_replace(made, '\\s{{2,}}', ' ', 'g'), '\\s+([:.,])', '\\1', 'g')) END AS text, confidence, x1, y1, x2, y2,
     len(list_filter(ws, lambda x: NOT x.s)) + len(free) > 0 AS met FROM texts),
 latin AS (SELECT * EXCLUDE (met) FROM kept WHERE NOT met OR length(trim(text, '.,:;()[]|- ')) > 0),
 glossed AS (SELECT * FROM latin UNION ALL
   SELECT 'script', doc_id, page, box_no, text, confidence, x1, y1, x2, y2 FROM words w LEFT JOIN ends e USING (doc_id, page)
   WHERE confidence >= 0.5 AND NOT list_contains(list_transform(coalesce(e.taken, []), lambda t: t.w), box_no)
     AND NOT EXISTS (SELECT 1 FROM latin b WHERE b.doc_id = w.doc_id AND b.page = w.page AND b.confidence >= 0.85
       AND greatest(0, least(b.x2, w.x2) - greatest(b.x1, w.x1)) * greatest(0, least(b.y2, w.y2) - greatest(b.y1, w.y1))
         / ((w.x2 - w.x1) * (w.y2 - w.y1))::DOUBLE >= 0.6::DOUBLE))"""


@query("glosses_repaired", f"WITH {glosses_sql('m_boxes')} SELECT * FROM glossed")
def _(m):
    return L.repair_glosses(m.m_boxes, L.select_words(m.m_script_boxes))


BILINGUAL = f"bilingual AS (SELECT doc_id, page FROM ({WORD_KIND}) WHERE kind = 'trusted' GROUP BY 1, 2 HAVING count(*) >= {K.BILINGUAL_WORDS})"
FUSED = f"""{BILINGUAL}, here AS (SELECT b.* FROM m_boxes b JOIN bilingual USING (doc_id, page)), {glosses_sql('here')},
 fused AS (SELECT b.* FROM m_boxes b LEFT JOIN bilingual p USING (doc_id, page) WHERE p.doc_id IS NULL
   UNION ALL SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page
     ORDER BY CASE engine WHEN 'latin' THEN 0 WHEN 'script' THEN 1 ELSE 2 END, box_no, x1, y1, text) AS INT), text, confidence, x1, y1, x2, y2
   FROM (SELECT g.* FROM glossed g JOIN bilingual USING (doc_id, page) UNION ALL SELECT 'gloss', doc_id, page, box_no, text, confidence,
     x1, y1, x2, y2 FROM words JOIN bilingual USING (doc_id, page) WHERE kind = 'gloss'))"""


@query("readings_fused", f"WITH {FUSED} SELECT * FROM fused")
def _(m):
    return L.fuse(m.m_boxes, m.m_script_boxes)


TEMPLATE = "CASE " + " ".join(
    f"WHEN {' OR '.join([*(f'contains(upper(text), {quoted([t])})' for t in upper), *(f'contains(text, {quoted([t])})' for t in printed)])} "
    f"THEN {quoted([name])}" for name, upper, printed in P.TEMPLATES) + f" ELSE {quoted([P.DEFAULT_TEMPLATE])} END"


@query("pages_reconstructed", f"""
WITH {FUSED}, {rows_sql("fused")}, {LISTED}
SELECT *, {TEMPLATE} AS template FROM (SELECT doc_id, page, coalesce(text, '') AS text, CAST(coalesce(row_count, 0) AS BIGINT) AS row_count,
  CAST(coalesce(token_count, 0) AS BIGINT) AS token_count FROM listed LEFT JOIN pg USING (doc_id, page))""")
def _(m):
    pages = L.reconstruct(m.m_boxes, m.m_script_boxes, _listed(m))
    return pages.select("doc_id", "page", "text", "row_count", "token_count", "template")


# --- form fields --------------------------------------------------------------------------------

@query("form_fields", f"""
SELECT o_orderkey AS doc_id, concat(o_orderkey, '/', year(o_orderdate) % 100 + 100) AS fir_number,
  concat('ZONE ', o_custkey % 25) AS district, concat('STN ', o_custkey) AS police_station,
  CAST(year(o_orderdate) AS VARCHAR) AS "year",
  concat(10 + o_orderkey % 18, '/1', o_orderkey % 3, '/', year(o_orderdate)) AS registration_date,
  concat('1', o_orderkey % 10, ':', 10 + o_custkey % 50, ' hrs') AS registration_time, 'Written' AS type_of_information,
  concat('IPC ', 100 + o_custkey % 400, ',IPC ', 501 + o_orderkey % 10) AS ipc_sections,
  CASE o_custkey % 5 WHEN 0 THEN 'Ramesh Kumar' WHEN 1 THEN 'Priya Menon' WHEN 2 THEN 'Sunita Rao'
    WHEN 3 THEN 'Amit Verma' ELSE 'Kiran Bedi Shah' END AS complainant,
  concat('House ', o_custkey, ' Model Town') AS address, concat('NEAR ROAD ', o_orderkey) AS place_of_occurrence,
  CAST(NULL AS VARCHAR) AS incident_description FROM orders""")
def _(m):
    fields = m.spread("m_forms").select("doc_id", FF.fir_fields(F.col("text")).alias("f")).select("doc_id", "f.*")
    return fields.withColumn("ipc_sections", F.array_join("ipc_sections", ","))


@query("form_sections", """
SELECT o_orderkey AS doc_id, unnest([concat('IPC ', 100 + o_custkey % 400), concat('IPC ', 501 + o_orderkey % 10)]) AS section
FROM orders""")
def _(m):
    return m.spread("m_forms").select("doc_id", F.explode(FF.statute_sections(F.col("text"))).alias("section"))


@query("form_registration_times", """
SELECT o_orderkey AS doc_id, concat('1', o_orderkey % 10, ':', 10 + o_custkey % 50, ' hrs') AS registration_time FROM orders""")
def _(m):
    return m.spread("m_forms").select("doc_id", FF.registration_time(F.col("text")).alias("registration_time"))


@query("form_templates", """
SELECT doc_id, CASE WHEN contains(u, 'DELHI') OR contains(u, 'BNS.S') OR contains(u, 'BHARATIYA NYAYA') THEN 'Delhi Police FIR'
  WHEN contains(u, 'HARYANA') THEN 'Haryana Police FIR' WHEN contains(u, 'UTTAR PRADESH') THEN 'UP Police FIR'
  ELSE 'Standard Indian Police FIR' END AS template
FROM (SELECT doc_id, upper(CASE lang WHEN 'fr' THEN concat('Haryana ', text) WHEN 'de' THEN concat('Bharatiya Nyaya ', text)
  WHEN 'es' THEN concat('Uttar Pradesh ', text) ELSE text END) AS u FROM documents)""")
def _(m):
    text = F.expr("CASE lang WHEN 'fr' THEN concat('Haryana ', text) WHEN 'de' THEN concat('Bharatiya Nyaya ', text) "
                  "WHEN 'es' THEN concat('Uttar Pradesh ', text) ELSE text END")
    return m.documents.select("doc_id", FF.form_template(text).alias("template"))


@query("digits_folded", """
SELECT doc_id, sha256(translate(translate(text, '0123456789', '०१२३४५६७८९'), '०१२३४५६७८९', '0123456789')) AS folded_hash
FROM documents""")
def _(m):
    printed = F.translate("text", "0123456789", "०१२३४५६७८९")
    return m.documents.select("doc_id", F.sha2(X.fold_digits(printed), 256).alias("folded_hash"))


# --- uploaded files -----------------------------------------------------------------------------

KIND = """kinds AS (SELECT *, CASE WHEN starts_with(body, '%PDF') THEN 'application/pdf'
    WHEN starts_with(body, 'MZ') THEN 'application/x-dosexec' WHEN starts_with(body, '#!') THEN 'text/x-shellscript'
    WHEN declared IN ('text/plain', 'text/csv') THEN declared ELSE 'application/octet-stream' END AS mime FROM m_blobs)"""
THREAT = KIND + r""", threats AS (SELECT *, CASE
    WHEN mime = 'application/pdf' AND contains(regexp_replace(body, 'stream\r?\n.*?endstream', '', 'gs'), '/JS')
      THEN 'pdf action /JS'
    WHEN mime IN ('text/plain', 'text/csv') AND contains(lower(body), '<script') THEN 'script marker <script'
    WHEN mime IN ('text/plain', 'text/csv') AND contains(lower(body), 'javascript:') THEN 'script marker javascript:'
    WHEN mime IN ('text/plain', 'text/csv') AND contains(lower(body), 'powershell') THEN 'script marker powershell'
    END AS threat FROM kinds)"""


def _typed(m):
    return m.m_blobs.select("page_id", "content", F.length("content").cast("long").alias("size"),
                            B.sniff_mime(F.col("content"), F.col("declared")).alias("mime"))


@query("blob_inventory")
def _(m):
    """Names and sizes only; the files themselves are not read."""
    files = B.scan_blobs(m.spark, m.sf_dir, "*.parquet")
    return files.select(F.substring_index("path", "/", -1).alias("name"), "size")


@query("blob_types", f"WITH {KIND} SELECT page_id, octet_length(encode(body)) AS size, mime FROM kinds")
def _(m):
    return _typed(m).drop("content")


@query("blob_threats", f"WITH {THREAT} SELECT page_id, mime, threat FROM threats")
def _(m):
    return B.scan_threats(_typed(m)).select("page_id", "mime", "threat")


@query("blob_gate", f"""
WITH {THREAT} SELECT page_id, reason, CASE WHEN reason IS NULL THEN 'accept' ELSE 'reject' END AS verdict FROM (
  SELECT page_id, CASE WHEN mime NOT IN ('application/pdf', 'text/plain', 'text/csv') THEN 'unsupported_type'
    WHEN threat IS NOT NULL THEN 'threat' END AS reason FROM threats)""")
def _(m):
    return B.gate_blobs(B.scan_threats(_typed(m))).select("page_id", "reason", "verdict")


@query("blob_texts", f"""
WITH {KIND} SELECT page_id, CASE WHEN mime IN ('text/plain', 'text/csv') THEN sha256(body) END AS text_hash FROM kinds""")
def _(m):
    text = B.decode_text(F.col("content"), F.col("mime"))
    return _typed(m).select("page_id", F.sha2(text, 256).alias("text_hash"))


@query("blob_fingerprints", "SELECT page_id, sha256(body) AS doc_hash FROM m_blobs")
def _(m):
    return m.m_blobs.select("page_id", F.sha2("content", 256).alias("doc_hash"))


@query("file_names_sanitised", r"""
SELECT page_id, CASE WHEN length(n) = 0 THEN 'unnamed_upload' ELSE substring(n, 1, 255) END AS clean FROM (
  SELECT page_id, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[^\p{L}\p{N}_.\-]', '_', 'g') AS n FROM m_blobs)""")
def _(m):
    return m.m_blobs.select("page_id", X.sanitize_name(F.col("name")).alias("clean"))
