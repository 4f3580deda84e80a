"""Documents as files, as versions, and as Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog import columns  # noqa: F401  (defines the "files" input)
from opsframe.catalog.normalizing import sql_strip
from opsframe.catalog.registry import given, query
from opsframe.functions.text import CATEGORIES, category, extension
from opsframe.operators import inventory, mdcorpus, reconcile, versions
from opsframe.plans import archive

# --- files ------------------------------------------------------------------------------------------------------

_EXT = "regexp_extract(split_part(path, '/', -1), '^\\.*[^.].*?(\\.[^.]*)$', 1)"
_CAT = f"CASE lower({_EXT}) " + " ".join(
    f"WHEN '{e}' THEN '{name}'" for name, exts in CATEGORIES.items() for e in exts) + " ELSE '其他' END"


@query("file_categories", f"""
SELECT path, lower({_EXT}) AS ext, {_CAT} AS category,
  CASE WHEN octet_length(encode(text)) = 0 THEN 'empty' WHEN octet_length(encode(text)) < 1024 THEN 'tiny' ELSE 'ok' END AS size_flag FROM files""")
def _(t):
    return inventory.classify(t.files, "path", F.octet_length("text")).select("path", "ext", "category", "size_flag")


@query("extension_tally", f"SELECT CASE WHEN {_EXT} = '' THEN '(无扩展名)' ELSE lower({_EXT}) END AS ext, count(*) AS n FROM files GROUP BY 1")
def _(t):
    return inventory.extension_tally(t.files, "path")


@query("size_flags", """
SELECT CASE WHEN s = 0 THEN 'empty' WHEN s < 1024 THEN 'tiny' ELSE 'ok' END AS flag, count(*) AS n
FROM (SELECT octet_length(encode(text)) AS s FROM files) GROUP BY 1""")
def _(t):
    from opsframe.operators.quality import size_flag

    return t.files.groupBy(size_flag(F.octet_length("text")).alias("flag")).agg(F.count("*").alias("n"))


given("file_list", f"""
SELECT doc_id, path, text AS body, n_chars FROM files
UNION ALL SELECT doc_id, path || '.lock' AS path, '' AS body, 0 AS n_chars FROM files WHERE doc_id % 2 = 0""")


def _files(t):
    return t.file_list.select("path", F.sha2("body", 256).alias("fingerprint"), F.octet_length("body").alias("size"))


_MARKED = f"""
prints AS (SELECT path, sha256(body) AS fingerprint, octet_length(encode(body)) AS size, {_EXT} AS ext, {_CAT} AS category FROM file_list),
marked AS (SELECT *, min(path) OVER (PARTITION BY fingerprint) AS original, count(*) OVER (PARTITION BY fingerprint) AS n_copies FROM prints)"""


@query("content_duplicates", f"""
WITH {_MARKED} SELECT path, fingerprint, original, n_copies, path <> original AS is_duplicate FROM marked""")
def _(t):
    return inventory.mark_duplicates(_files(t), "path", "fingerprint").drop("size")


@query("content_duplicates_salted", f"""
WITH {_MARKED} SELECT path, fingerprint, original, n_copies, path <> original AS is_duplicate FROM marked""")
def _(t):
    """The same with a low threshold, so that hot fingerprints take the salted way."""
    return inventory.mark_duplicates(_files(t), "path", "fingerprint", hot_rows=20).drop("size")


@query("category_tally", f"""
WITH {_MARKED} SELECT CASE WHEN path <> original THEN '_重复文件' ELSE category END AS category, count(*) AS n FROM marked GROUP BY 1""")
def _(t):
    marked = inventory.mark_duplicates(_files(t), "path", "fingerprint")
    return inventory.category_tally(marked.withColumn("category", category(extension("path"))))


_INDEXED = f"""
indexed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS i FROM marked WHERE path = original)"""


@query("archive_plan", f"""
WITH {_MARKED}, {_INDEXED}
SELECT path, category || '/' || category || '_20260924_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || lower(ext) AS target,
  category, size, fingerprint, original FROM indexed
UNION ALL SELECT path, '_重复文件/' || replace(path, '/', '__'), '重复件', size, fingerprint, original FROM marked WHERE path <> original""")
def _(t):
    return archive.archive_plan(_files(t), "path", day=F.lit("2026-09-24").cast("date"))


given("same_names", """
SELECT 'dir' || CAST(p_partkey AS STRING) || '/' || p_name || '.txt' AS path, CAST(p_partkey AS STRING) AS body FROM part""")


@query("archive_plan_collisions", """
SELECT path, '文档/' || stem || CASE WHEN n = 1 THEN '' ELSE '(' || CAST(n AS VARCHAR) || ')' END || '.txt' AS target FROM (
  SELECT path, stem, row_number() OVER (PARTITION BY stem ORDER BY path) AS n FROM (SELECT path, replace(split_part(path, '/', -1), '.txt', '') AS stem FROM same_names))""")
def _(t):
    files = t.same_names.select("path", F.sha2("body", 256).alias("fingerprint"), F.octet_length("body").alias("size"))
    return archive.archive_plan(files, "path", keep_name=True, day=F.lit("2026-09-24").cast("date")).select("path", "target")


# --- versions ---------------------------------------------------------------------------------------------------

given("new_versions", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'appended ' || CAST(doc_id AS STRING)
  WHEN 2 THEN 'first ' || CAST(doc_id AS STRING) || chr(10) || text ELSE 'only ' || CAST(doc_id AS STRING) END AS text FROM documents""")
given("moved_versions", """
SELECT doc_id, replace(replace(text, ' the ', ' THE '), chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE chr(10) || 'x' || chr(10) END) AS text FROM documents""")


def _sql_lines(x: str) -> str:
    s = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split(CASE WHEN length({s}) > 0 AND {s} LIKE '%' || chr(10) THEN left({s}, length({s}) - 1) ELSE {s} END, chr(10)) END)"


@query("doc_lines", f"""
SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM documents)""")
def _(t):
    from opsframe.functions.text import lines

    return t.documents.select("doc_id", F.posexplode(lines("text")).alias("pos", "line"))


@query("doc_diff_counts", f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0 ELSE 1 END AS added, CASE WHEN doc_id % 4 = 3 THEN n WHEN doc_id % 4 = 1 AND ends THEN 0 ELSE 0 END AS removed,
  CASE WHEN doc_id % 4 = 3 THEN 0 ELSE n END AS unchanged
FROM (SELECT doc_id, len({_sql_lines('text')}) AS n, text LIKE '%' || chr(10) AS ends FROM documents)""")
def _(t):
    return versions.diff_counts(versions.diff_versions(t.documents, t.new_versions, "doc_id", "text"), "doc_id")


given("label_texts", "SELECT doc_id, 'quality ' || CAST(quality AS STRING) AS text FROM labels")


@query("doc_diff_one_sided", f"""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS added, coalesce(d.n, 0) AS removed, 0 AS unchanged
FROM (SELECT doc_id, len({_sql_lines('text')}) AS n FROM documents) d FULL JOIN label_texts l ON d.doc_id = l.doc_id WHERE d.n > 0 OR l.doc_id IS NOT NULL""")
def _(t):
    """Most documents have no second version: all of their lines are removed."""
    return versions.diff_counts(versions.diff_versions(t.documents, t.label_texts, "doc_id", "text"), "doc_id")


@query("doc_diff_lcs")
def _(t):
    return versions.diff_versions(t.documents, t.moved_versions, "doc_id", "text", ignore_space=True)


@query("doc_diff_rebuilt", f"""
SELECT d.doc_id, array_to_string(d.l, chr(10)) AS old_text, array_to_string(m.l, chr(10)) AS new_text, len(d.l) AS n_old, len(m.l) AS n_new
FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM documents) d JOIN (SELECT doc_id, {_sql_lines('text')} AS l FROM moved_versions) m USING (doc_id)
WHERE len(d.l) + len(m.l) > 0""")
def _(t):
    """Both versions put together again from the steps between them."""
    steps = versions.diff_versions(t.documents, t.moved_versions, "doc_id", "text")
    rows = lambda op: F.array_sort(F.collect_list(F.when(F.col("op") != op, F.struct("op_no", "line"))))
    both = steps.groupBy("doc_id").agg(rows("add").alias("o"), rows("del").alias("n"))
    return both.select("doc_id", F.array_join("o.line", "\n").alias("old_text"), F.array_join("n.line", "\n").alias("new_text"),
                       F.size("o").alias("n_old"), F.size("n").alias("n_new"))


given("order_old", """
SELECT o_orderkey AS doc_id, 'key ' || CAST(o_orderkey AS STRING) || chr(10) || 'customer ' || CAST(o_custkey AS STRING) || chr(10) || 'status ' || o_orderstatus
  || chr(10) || 'price ' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) || chr(10) || 'priority ' || o_orderpriority || chr(10) || 'end' AS text FROM orders""")
given("order_new", """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 0 THEN 'head' || chr(10) ELSE '' END || 'key ' || CAST(o_orderkey AS STRING)
  || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'customer ' || CAST(o_custkey AS STRING) ELSE '' END
  || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || 'status changed' || chr(10) || 'by hand' WHEN 1 THEN chr(10) || 'status ' || o_orderstatus ELSE '' END
  || chr(10) || 'price ' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'note' ELSE '' END
  || chr(10) || 'priority ' || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN '!' ELSE '' END || chr(10) || 'end' AS text FROM orders""")


@query("doc_diff_script", f"""
WITH a AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM order_old)),
b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM order_new)),
old AS (SELECT a.doc_id, a.line, a.n AS a_line, b.n AS b_line, coalesce(sum(CASE WHEN b.n IS NULL THEN 0 ELSE 1 END) OVER (
  PARTITION BY a.doc_id ORDER BY a.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.line = b.line),
new AS (SELECT b.doc_id, b.line, a.n AS a_line, b.n AS b_line, coalesce(sum(CASE WHEN a.n IS NULL THEN 0 ELSE 1 END) OVER (
  PARTITION BY b.doc_id ORDER BY b.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM b LEFT JOIN a ON a.doc_id = b.doc_id AND a.line = b.line),
steps AS (SELECT *, CASE WHEN b_line IS NULL THEN 'del' ELSE 'eq' END AS op, CASE WHEN b_line IS NULL THEN 0 ELSE 2 END AS kind, a_line AS pos FROM old
  UNION ALL SELECT *, 'add', 1, b_line FROM new WHERE a_line IS NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, kind, pos) AS op_no, op, a_line, b_line, line FROM steps""")
def _(t):
    """Lines that differ from each other and keep their order: the steps follow from the lines both versions have."""
    return versions.diff_versions(t.order_old, t.order_new, "doc_id", "text")


given("order_moved", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'end' || chr(10) ELSE '' END || 'price ' || CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) || chr(10) || 'key ' || CAST(o_orderkey AS STRING)
  || CASE o_orderkey % 3 WHEN 0 THEN chr(10) || 'status ' || o_orderstatus || chr(10) || 'end' WHEN 1 THEN chr(10) || 'new' || chr(10) || 'key ' || CAST(o_orderkey AS STRING) ELSE '' END
  || chr(10) || 'customer ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 5 < 2 THEN chr(10) || 'priority ' || o_orderpriority || chr(10) || 'status ' || o_orderstatus ELSE '' END
  || chr(10) || 'end' AS text FROM orders""")


@query("doc_diff_longest", f"""
WITH RECURSIVE a AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM order_old)),
b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM order_moved)),
met AS (SELECT a.doc_id, i, j FROM a JOIN b ON a.doc_id = b.doc_id AND a.line = b.line),
chain AS (SELECT doc_id, i, j, 1 AS n FROM met
  UNION SELECT c.doc_id, m.i, m.j, c.n + 1 FROM chain c JOIN met m ON m.doc_id = c.doc_id AND m.i > c.i AND m.j > c.j),
best AS (SELECT doc_id, max(n) AS n FROM chain GROUP BY doc_id)
SELECT a.doc_id, n_b - coalesce(n, 0) AS added, n_a - coalesce(n, 0) AS removed, coalesce(n, 0) AS unchanged
FROM (SELECT doc_id, count(*) AS n_a FROM a GROUP BY doc_id) a JOIN (SELECT doc_id, count(*) AS n_b FROM b GROUP BY doc_id) b ON a.doc_id = b.doc_id
LEFT JOIN best ON best.doc_id = a.doc_id""")
def _(t):
    """Lines moved and repeated: the SQL grows every common subsequence and takes the longest."""
    return versions.diff_counts(versions.diff_versions(t.order_old, t.order_moved, "doc_id", "text"), "doc_id")


@query("doc_diff_folded", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE n - 1 END AS added, 0 AS removed, n AS unchanged
FROM (SELECT doc_id, len({_sql_lines('text')}) AS n FROM documents WHERE text <> '')""")
def _(t):
    return versions.diff_counts(
        versions.diff_versions(t.documents, t.moved_versions, "doc_id", "text", ignore_case=True, ignore_space=True), "doc_id")


@query("doc_diff_multiset", f"""
WITH sides AS (SELECT doc_id, unnest({_sql_lines('text')}) AS line, 1 AS o, 0 AS n FROM documents
  UNION ALL SELECT doc_id, unnest({_sql_lines('text')}), 0, 1 FROM moved_versions),
counted AS (SELECT doc_id, line, sum(o) AS o, sum(n) AS n FROM sides GROUP BY ALL)
SELECT doc_id, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS removed,
  CAST(sum(least(o, n)) AS BIGINT) AS unchanged FROM counted GROUP BY doc_id""")
def _(t):
    return reconcile.line_multiset_diff(t.documents, t.moved_versions, "doc_id", "text")


@query("unified_text", f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN body WHEN 1 THEN body || chr(10) || '+ appended ' || CAST(doc_id AS VARCHAR)
  WHEN 2 THEN '+ first ' || CAST(doc_id AS VARCHAR) || chr(10) || body
  ELSE array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) || chr(10) || '+ only ' || CAST(doc_id AS VARCHAR) END AS unified
FROM (SELECT doc_id, l, array_to_string(list_transform(l, lambda x: '  ' || x), chr(10)) AS body FROM (SELECT doc_id, {_sql_lines('text')} AS l FROM documents))""")
def _(t):
    return versions.unified_text(versions.diff_versions(t.documents, t.new_versions, "doc_id", "text"), "doc_id")


# --- Markdown ---------------------------------------------------------------------------------------------------

given("md_docs", """
SELECT doc_id, '# Title *' || CAST(doc_id AS STRING) || '* 报告' || chr(10) || text || chr(10) || chr(10) || '## Same' || chr(10) || 'see [a](http://x/' || CAST(doc_id AS STRING) || ') and ![i](p.png)'
  || chr(10) || 'not `[c](d)` ~~old~~ **b**' || chr(10) || '- one' || chr(10) || '* two [l](u)' || chr(10) || '1. first' || chr(10) || '2) second' || chr(10) || '---' || chr(10) || '> quote' || chr(10) || '>more'
  || chr(10) || CASE doc_id % 3 WHEN 0 THEN '| h1 | h2 |' || chr(10) || '|----|:--:|' || chr(10) || '| a | b |' || chr(10) || 'c | d | e' || chr(10) || '# x | y' || chr(10)
     WHEN 1 THEN '```sql' || chr(10) || '# not a heading' || chr(10) || 'a | b' || chr(10) || '```' || chr(10) ELSE '' END
  || '## Same' || chr(10) || '### ' || chr(10) || '####### seven' || chr(10) || '```' || chr(10) || '- open fence' AS text FROM documents""")

_MD_LINES = f"""
md_raw AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS n FROM (
  SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM md_docs)),
md_t AS (SELECT *, {sql_strip('raw')} AS t FROM md_raw),
md_f AS (SELECT *, sum(CASE WHEN t LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS marks FROM md_t),
md_p AS (SELECT *, (marks % 2 = 1 OR t LIKE '```%') AS fenced, t LIKE '```%' AND marks % 2 = 1 AS opens FROM md_f),
md_q AS (SELECT *, contains(t, '|') AND NOT fenced AS pipe, regexp_matches(t, '^[-*+]\\s+') AND NOT fenced AS bullet, regexp_matches(t, '^\\d+[.)]\\s+') AND NOT fenced AS num FROM md_p),
md_s AS (SELECT *, pipe AND regexp_matches(t, '^[\\s|:-]+$') AND contains(t, '-') AS sep FROM md_q),
md_h AS (SELECT *, pipe AND coalesce(lead(sep) OVER w, false) AND NOT regexp_matches(t, '^#{{1,6}}\\s+') AND t NOT LIKE '>%'
    AND NOT (bullet AND coalesce(lag(bullet) OVER w, false)) AND NOT (num AND coalesce(lag(num) OVER w, false)) AS header,
  n - sum(CASE WHEN pipe THEN 1 ELSE 0 END) OVER w AS gap FROM md_s WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
md_at AS (SELECT *, min(CASE WHEN header THEN n END) OVER (PARTITION BY doc_id, pipe, gap) AS table_at FROM md_h),
md_k AS (SELECT *, CASE WHEN fenced THEN 'fence' WHEN pipe AND n >= table_at THEN 'table' WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^(-{{3,}}|\\*{{3,}}|_{{3,}})$') THEN 'rule'
  WHEN regexp_matches(t, '^#{{1,6}}\\s+') THEN 'heading' WHEN t LIKE '>%' THEN 'quote' WHEN bullet THEN 'ul' WHEN num THEN 'ol' ELSE 'paragraph' END AS kind FROM md_at),
md_b AS (SELECT *, kind <> 'blank' AND (coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') <> kind OR kind IN ('rule', 'heading') OR opens) AS head FROM md_k),
md AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block_no, n - table_at AS table_line,
  CASE WHEN kind = 'fence' AND t NOT LIKE '```%' THEN raw WHEN kind = 'heading' THEN {sql_strip("regexp_extract(t, '^(#{1,6})\\s+(.*)$', 2)")}
    WHEN kind = 'quote' THEN regexp_replace(t, '^>\\s?', '') WHEN kind = 'ul' THEN regexp_replace(t, '^[-*+]\\s+', '') WHEN kind = 'ol' THEN regexp_replace(t, '^\\d+[.)]\\s+', '')
    WHEN kind = 'paragraph' OR (kind = 'table' AND n - table_at <> 1) THEN t END AS content FROM md_b)"""


@query("md_blocks", f"""
WITH {_MD_LINES} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, min(kind) AS kind, min(n) + 1 AS first_line, count(*) AS n_lines,
  coalesce(string_agg(content, chr(10) ORDER BY n), '') AS text FROM md WHERE kind <> 'blank' GROUP BY doc_id, block_no""")
def _(t):
    return mdcorpus.md_blocks(t.md_docs, "doc_id", "text")


@query("md_census", f"WITH {_MD_LINES} SELECT doc_id, kind, count(*) AS n FROM md WHERE head GROUP BY ALL")
def _(t):
    return mdcorpus.md_census(t.md_docs, "doc_id", "text")


@query("md_elements", f"""
WITH {_MD_LINES} SELECT doc_id, count(*) FILTER ((head AND kind IN ('heading', 'paragraph', 'fence')) OR kind IN ('ul', 'ol') OR (kind = 'table' AND table_line <> 1)) AS n_elements
FROM md WHERE kind <> 'blank' GROUP BY doc_id""")
def _(t):
    return mdcorpus.md_elements(t.md_docs, "doc_id", "text")


@query("md_headings", f"""
WITH {_MD_LINES}, slugs AS (SELECT *, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(content), '[`*_~\\[\\]()#!]', '', 'g'), '\\s+', '-', 'g'), '[^A-Za-z0-9_一-龥-]', '', 'g') AS s FROM md WHERE kind = 'heading'))
SELECT doc_id, n + 1 AS line_no, length(regexp_extract(t, '^#+')) AS level, content AS title,
  slug || CASE WHEN k = 1 THEN '' ELSE '-' || CAST(k - 1 AS VARCHAR) END AS anchor
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY n) AS k FROM slugs)""")
def _(t):
    return mdcorpus.md_headings(t.md_docs, "doc_id", "text")


@query("md_tables", f"""
WITH {_MD_LINES}, rows AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CASE WHEN table_line = 0 THEN 0 ELSE table_line - 1 END AS row_no,
    list_transform(string_split(regexp_replace(regexp_replace(t, '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c)) AS cells FROM md WHERE kind = 'table' AND table_line <> 1),
heads AS (SELECT doc_id, block_no, cells AS names FROM rows WHERE row_no = 0)
SELECT r.doc_id, r.block_no, row_no, i AS col_no, names[i] AS header, coalesce(cells[i], '') AS value
FROM rows r JOIN heads h ON h.doc_id = r.doc_id AND h.block_no = r.block_no, LATERAL (SELECT unnest(generate_series(1, len(names))) AS i)""")
def _(t):
    return mdcorpus.md_tables(t.md_docs, "doc_id", "text")


_UNITS = f"""{_MD_LINES},
units AS (SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CASE WHEN kind IN ('paragraph', 'quote') THEN 0 ELSE n END AS unit_no, kind,
  string_agg(content, chr(10) ORDER BY n) AS text FROM md WHERE kind NOT IN ('blank', 'fence', 'rule') AND content IS NOT NULL GROUP BY ALL)"""
_IMG, _LNK = "!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)", "\\[([^\\]]*)\\]\\(([^)\\s]+)\\)"


@query("md_links", f"""
WITH {_UNITS}, plain AS (SELECT *, regexp_replace(text, '`[^`]+`', ' ', 'g') AS p FROM units),
rest AS (SELECT *, regexp_replace(p, '{_IMG}', '\\1', 'g') AS r FROM plain),
found AS (SELECT doc_id, block_no, unit_no, list_concat(list_transform(regexp_extract_all(p, '{_IMG}', 0), lambda x: 'image'), list_transform(regexp_extract_all(r, '{_LNK}', 0), lambda x: 'link')) AS k,
  list_concat(regexp_extract_all(p, '{_IMG}', 1), regexp_extract_all(r, '{_LNK}', 1)) AS l, list_concat(regexp_extract_all(p, '{_IMG}', 2), regexp_extract_all(r, '{_LNK}', 2)) AS u FROM rest)
SELECT doc_id, block_no, unit_no, generate_subscripts(k, 1) - 1 AS pos, unnest(k) AS kind, unnest(l) AS label, unnest(u) AS url FROM found""")
def _(t):
    return mdcorpus.md_links(t.md_docs, "doc_id", "text")


given("inline_texts", """
SELECT item_id, '**' || text || '** *it* ~~gone~~ a < b & c' AS body FROM benchmark""")


@query("md_inline", """
SELECT item_id, '<strong>' || replace(text, chr(10), chr(10)) || '</strong> <em>it</em> <del>gone</del> a &lt; b &amp; c' AS html,
  text || ' it gone a < b & c' AS plain FROM benchmark""")
def _(t):
    return t.inline_texts.select("item_id", mdcorpus.inline_html("body").alias("html"), mdcorpus.inline_text("body").alias("plain"))
