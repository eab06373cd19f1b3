"""Registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import excerpt as X
from .functions import text as T
from .operators import files as O
from .operators import members as M
from .operators import migrate as G
from .operators.literals import literal_matches
from .operators.measures import Measures
from .operators.store import Store
from .plans import contents as K
from .plans import highlight as H
from .plans import index as I
from .plans import literal as L
from .plans import nodes as _nodes  # noqa: F401  adds begins: to the language
from .plans import scan as S
from .plans import texts as P
from .plans.corpus import EPOCH, documents, table
from .plans.regex import regex_scan
from .session import shared_folder
from .sources.readers import extracted, html_title
from .streaming import changes as C
from .streaming.source import NAME as SOURCE
from .streaming.source import register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TOKENS = r"list_filter(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: length(w) <= 64)"
FOLDED = _TOKENS.format("lower(strip_accents(replace(text, 'ß', 'ss')))")
AS_IS = _TOKENS.format("text")
DOCS = f"""d AS (SELECT doc_id, text, lang, source, '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, '/corpus/' || source || '/' || lang AS parent,
 doc_id || '.txt' AS name, strlen(text) AS size, {EPOCH} + doc_id * 3600 AS mtime, {FOLDED} AS toks, ' ' || array_to_string({FOLDED}, ' ') || ' ' AS c, ' ' || doc_id || ' txt ' AS n FROM documents)"""


def _has(pattern: str) -> str:
    return f"(contains(c, '{pattern}') OR contains(n, '{pattern}'))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _smart(name: str, text: str, where: str, **options) -> None:
    """A query of the search language, by a scan and by the index, against one condition in SQL."""
    sql = f"WITH {DOCS} SELECT doc_id FROM d WHERE {where}"
    query(f"smart_{name}", sql)(lambda spark, d: S.smart(documents(spark, d), text, **{k: v() if k == "filters" else v for k, v in options.items()}).select("doc_id"))
    if not options.get("case_sensitive") and "filters" not in options:
        query(f"index_{name}", sql)(lambda spark, d: _index(spark, d).matches(text, whole_word=options.get("whole_word", False), now=options.get("now")))


_WRITTEN: dict[tuple, str] = {}


def _written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str], None]) -> str:
    """The folder of an index over a folder's documents, written once in an application and read by all its queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        where = shared_folder(spark, name)
        write(documents(spark, sf_dir), where)
        _WRITTEN[key] = where
    return _WRITTEN[key]


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    return I.Index.open(documents(spark, sf_dir), _written(spark, sf_dir, "index", I.write))


def _literals(spark: SparkSession, sf_dir: str) -> L.LiteralIndex:
    return L.LiteralIndex(documents(spark, sf_dir), _written(spark, sf_dir, "literals", L.write))


_smart("term", "then", _has(" then"))
_smart("whole_word", "then", _has(" then "), whole_word=True)
_smart("prefix", "enth*", _has(" enth"), whole_word=True)
_smart("short_prefix", "e*", _has(" e "))
_smart("phrase", '"of the"', _has(" of the "))
_smart("phrase_prefix", "of-the", _has(" of the"))
_smart("and", "with AND for", f"{_has(' with')} AND {_has(' for')}")
_smart("or", "with OR das", f"{_has(' with')} OR {_has(' das')}")
_smart("not", "with -for", f"{_has(' with')} AND NOT {_has(' for')}")
_smart("grouped", "(with OR das) AND NOT (for OR und)", f"({_has(' with')} OR {_has(' das')}) AND NOT ({_has(' for')} OR {_has(' und')})")
_smart("pure_not", "NOT for", f"NOT {_has(' for')}")
_smart("folded", "éléments OR fur OR Strasse OR que", " OR ".join(_has(f" {w}") for w in ("elements", "fur", "strasse", "que")))
_smart("filter_ext_kind", "ext:txt type:text with", _has(" with"))
_smart("filter_path", "path:src3 with", f"contains(' ' || array_to_string(regexp_extract_all(lower(parent), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' src3 ') AND {_has(' with')}")
_smart("filter_in", "in:/corpus/src1/en", "starts_with(parent || '/', '/corpus/src1/en/')")
_smart("filter_name_glob", "filename:1?5*", "regexp_matches(name, '^1.5.*$')")
_smart("filter_name_contains", "filename:99", "contains(name, '99')")
_smart("filter_modified", "modified:2024-01-05..2024-01-20", f"mtime >= epoch(DATE '2024-01-05') AND mtime < epoch(DATE '2024-01-21')")
_smart("filter_modified_after", "modified:>2024-01 with", f"mtime >= epoch(DATE '2024-02-01') AND {_has(' with')}")
_smart("filter_size", "size:<=2kb", "size < 2049")
_smart("filter_size_range", "size:1kb..1.5kb with", f"size >= 1024 AND size < 1537 AND {_has(' with')}")
_smart("case_sensitive", "The", f"contains(' ' || array_to_string({AS_IS}, ' ') || ' ', ' The')", case_sensitive=True)
_smart("own_node", "begins:the OR (begins:der -for)", "starts_with(c, ' the ') OR (starts_with(c, ' der ') AND NOT " + _has(" for") + ")")
_smart("ui_filters", "with", f"size >= 1000 AND size <= 3000 AND mtime < {EPOCH + 900 * 3600} AND starts_with(parent || '/', '/corpus/src2/') AND {_has(' with')}", filters=lambda: S.ui_filters(("txt",), ("text",), ("/corpus/src2",), None, EPOCH + 900 * 3600, 1000, 3000))


@query("exact_literal", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)of\s+the') OR regexp_matches(doc_id || '.txt', '(?i)of\s+the')")
def exact_literal(spark, d):
    return S.exact(documents(spark, d), "of the").select("doc_id")


@query("exact_batch", r"SELECT item_id, doc_id FROM benchmark b JOIN documents t ON contains(regexp_replace(t.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g'))")
def exact_batch(spark, d):
    return literal_matches(documents(spark, d), table(spark, d, "benchmark"))


_PATTERN = "then[a-z]+ing"
_REGEX_SQL = f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){_PATTERN}')"
query("regex_scan", _REGEX_SQL)(lambda spark, d: regex_scan(documents(spark, d), _PATTERN, prefilter=False).select("doc_id"))
query("regex_prefiltered", _REGEX_SQL)(lambda spark, d: regex_scan(documents(spark, d), _PATTERN).select("doc_id"))
query("filename_mode", "SELECT doc_id FROM documents WHERE contains(doc_id || '.txt', '1') AND regexp_matches(doc_id || '.txt', '^.*5\\.txt$')")(lambda spark, d: S.filename(documents(spark, d), "1 *5.txt").select("doc_id"))

query("term_stats", f"WITH t AS (SELECT doc_id, unnest({FOLDED}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")(
    lambda spark, d: I.term_counts(documents(spark, d), ("content",)).select("term", "df", "cf")
)
query(
    "postings",
    f"WITH t AS (SELECT doc_id, unnest({FOLDED}) AS term, generate_subscripts({FOLDED}, 1) - 1 AS pos FROM documents) SELECT term, doc_id, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t GROUP BY ALL",
)(lambda spark, d: I.postings(documents(spark, d), ("content",)).select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions")))
query("doc_len", f"SELECT doc_id, len({FOLDED})::BIGINT AS n FROM documents WHERE len({FOLDED}) > 0")(lambda spark, d: I.lengths(I.postings(documents(spark, d), ("content",))).select("doc_id", "n"))


def _bm25(words: list[str], boosts: dict, match: str, limit: str) -> str:
    parts, stats = [], []
    for f, boost in boosts.items():
        toks = "toks" if f == "content" else "[doc_id::VARCHAR, 'txt']"
        stats.append(f"s_{f} AS (SELECT count(*) AS docs, avg(len({toks})) AS a FROM d WHERE len({toks}) > 0)")
        for i, w in enumerate(words):
            tf = f"len(list_filter({toks}, lambda t: t = '{w}'))"
            stats.append(f"f_{f}_{i} AS (SELECT count(*) AS df FROM d WHERE {tf} > 0)")
            parts.append(f"CASE WHEN {tf} > 0 THEN {boost} * ln(1 + (s_{f}.docs - f_{f}_{i}.df + 0.5) / (f_{f}_{i}.df + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({toks}) / s_{f}.a)) ELSE 0 END")
    names = [s.split(" ")[0] for s in stats]
    return f"WITH {DOCS}, {', '.join(stats)} SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM d, {', '.join(names)} WHERE {match} ORDER BY score DESC, doc_id {limit}"


query("search_ranked", _bm25(["with", "for"], {"content": 1.0, "name": 3.0}, f"{_has(' with ')} OR {_has(' for ')}", "LIMIT 10"))(lambda spark, d: I.ranked(_index(spark, d), "with OR for", whole_word=True))
query("bm25_page", _bm25(["with"], {"content": 1.0, "name": 3.0}, _has(" with "), "LIMIT 10 OFFSET 10"))(lambda spark, d: I.ranked(_index(spark, d), "with", 10, 10, whole_word=True))
query("bm25_boosted", _bm25(["with", "das"], {"content": 2.5}, f"{_has(' with ')} OR {_has(' das ')}", "LIMIT 25"))(lambda spark, d: I.ranked(_index(spark, d), "with OR das", 25, 0, {"content": 2.5, "name": 0.0}, True))
query("sort_modified", f"WITH {DOCS} SELECT doc_id, mtime FROM d WHERE {_has(' with')} ORDER BY mtime DESC, doc_id LIMIT 20")(
    lambda spark, d: S.smart(documents(spark, d), "with").orderBy(F.desc("mtime"), "doc_id").limit(20).select("doc_id", "mtime")
)
query("sort_size", f"WITH {DOCS} SELECT doc_id, size FROM d WHERE {_has(' with')} ORDER BY size DESC, doc_id LIMIT 20")(
    lambda spark, d: S.smart(documents(spark, d), "with").orderBy(F.desc("size"), "doc_id").limit(20).select("doc_id", "size")
)
query("sort_name", f"WITH {DOCS} SELECT doc_id, name FROM d WHERE {_has(' with')} ORDER BY name, doc_id LIMIT 20 OFFSET 20")(
    lambda spark, d: S.smart(documents(spark, d), "with").orderBy("name_lc", "doc_id").offset(20).limit(20).select("doc_id", "name")
)
query("hit_count", f"WITH {DOCS} SELECT count(*) AS total FROM d WHERE {_has(' with')}")(lambda spark, d: S.smart(documents(spark, d), "with").agg(F.count("*").alias("total")))
query("match_counts", f"SELECT doc_id, least(len(list_filter({FOLDED}, lambda t: t = 'the')), 999)::INT AS matches, len(list_filter({FOLDED}, lambda t: t = 'the')) > 999 AS capped FROM documents")(
    lambda spark, d: documents(spark, d).withColumn("n", F.size(F.filter(T.tokens(F.col("content")), lambda t: t == "the"))).select("doc_id", F.least("n", F.lit(999)).alias("matches"), (F.col("n") > 999).alias("capped"))
)
query("head_excerpt", "SELECT doc_id, translate(substring(text, 1, 90), chr(10) || chr(13) || chr(9), '   ') || CASE WHEN length(text) > 90 THEN '…' ELSE '' END AS head FROM documents")(
    lambda spark, d: documents(spark, d).select("doc_id", F.concat(F.translate(F.substring("content", 1, 90), "\n\r\t", "   "), F.when(F.length("content") > 90, "…").otherwise("")).alias("head"))
)


@query("snippets")
def snippets(spark, d):
    hits = S.smart(documents(spark, d), "with OR das")
    s = H.shown(hits, H.highlighter("smart", "with OR das"), keys=("doc_id",), heads=False)
    return s.select("doc_id", F.col("snippets.count").alias("count"), F.col("snippets.capped").alias("capped"), F.to_json("snippets.snippets").alias("snippets"))


@query("html_text")
def html_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.lit("page.html").alias("name"), F.col("html").alias("content"))
    return extracted(pages).select("page_id", "title", "content", "status")


_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"
query("html_title", rf"SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", html_title(F.col("html")).alias("title"))
)
query(
    "result_items",
    f"WITH {DOCS} SELECT doc_id, path, name, parent AS dir, size, mtime, 'text' AS kind FROM d WHERE {_has(' with')}",
)(lambda spark, d: S.smart(documents(spark, d), "with").select("doc_id", "path", "name", F.col("parent").alias("dir"), "size", "mtime", "kind"))
query(
    "member_items",
    "SELECT conv_id, turn, '/mail/' || conv_id || '.pst' || ' › ' || role AS dir, 'eml' AS ext, strlen(text) AS size FROM conversations WHERE contains(lower(text), 'the')",
)(lambda spark, d: table(spark, d, "conversations").filter(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn", F.concat_ws(" › ", F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.lit(".pst")), "role").alias("dir"), F.lit("eml").alias("ext"), F.octet_length("text").cast("long").alias("size")))
query("container_summary", "SELECT conv_id, count(*) AS messages, count_if(text IS NULL OR text = '')::BIGINT AS skipped FROM conversations GROUP BY conv_id")(
    lambda spark, d: M.container_summary(table(spark, d, "conversations"), "conv_id")
)


@query(
    "member_docs",
    """WITH m AS (SELECT '/mail/' || conv_id || '.pst' AS container, turn, role, text, coalesce(nullif(trim(substring(text, 1, 30), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''), '(no subject)') AS name, CASE WHEN turn % 3 <> 0 THEN role END AS sender FROM conversations)
 SELECT container || '/' || turn AS path, name, container || '/' AS dir, container || ' › ' || role AS shown_dir, ext, kind, strlen(text) AS size, CASE WHEN turn % 2 = 0 THEN turn * 60 ELSE 7 END::BIGINT AS mtime, concat_ws(chr(10), name, sender, role) AS meta
 FROM m, (SELECT 'eml' AS ext, 'text' AS kind)""",
)
def member_docs(spark, d):
    box = F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.lit(".pst"))
    sent = F.when(F.col("turn") % 2 == 0, F.col("turn") * 60).cast("long")
    mail = table(spark, d, "conversations").select(
        F.concat(box, F.lit("/"), F.col("turn").cast("string")).alias("path"), box.alias("container"), F.col("role").alias("folder"), F.substring("text", 1, 30).alias("subject"),
        F.when(F.col("turn") % 3 != 0, F.col("role")).alias("sender"), "text", sent.alias("sent"), F.lit(7).cast("long").alias("mtime"),
    )
    return M.member_docs(mail).drop("container", "content", "info")


def _files(spark, d) -> DataFrame:
    status = F.when(F.col("quality").isNull(), 1).when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 3).otherwise(0)
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    root = F.col("doc_id") % 7
    return documents(spark, d).join(known, "doc_id", "left").select("doc_id", "path", "dir", "size", "mtime", status.alias("status"), root.alias("root"), F.when(status == 2, F.lit(32)).when(status == 3, F.lit(17)).when(status == 1, F.lit(8)).otherwise(F.lit(0)).cast("long").alias("flags"))


def _gaps(events: DataFrame) -> DataFrame:
    """Times between the events of a user, by the type of the later one."""
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    found = O.percentiles(events.select("event_type", us.alias("us")), "us", ("event_type",))
    return found.select("event_type", "n", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95", "p99")])


FILES = f"""{DOCS}, k AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT d.doc_id, path, parent || '/' AS dir, size, mtime, doc_id % 7 AS root, CASE WHEN quality IS NULL THEN 1 WHEN quality = 0 THEN 2 WHEN toxic = 1 THEN 3 ELSE 0 END AS status FROM d LEFT JOIN k USING (doc_id))"""
query("status_counts", f"WITH {FILES} SELECT status, count(*) AS n FROM f GROUP BY status")(lambda spark, d: O.status_counts(_files(spark, d)))
query("root_counts", f"WITH {FILES} SELECT root, count(*) AS n FROM f WHERE status <> 6 GROUP BY root")(lambda spark, d: O.root_counts(_files(spark, d)))
query(
    "root_info",
    f"""WITH {FILES}, r AS (SELECT DISTINCT doc_id % 10 AS root, '/root/' || (doc_id % 10) AS path FROM documents),
 c AS (SELECT root, count(*) AS files, sum(size)::BIGINT AS bytes, count_if(status IN (2, 3, 4, 5))::BIGINT AS problems, max(mtime) AS last_mtime FROM f WHERE status <> 6 GROUP BY root)
 SELECT r.root, r.path, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes, coalesce(problems, 0) AS problems, last_mtime FROM r LEFT JOIN c USING (root)""",
)(lambda spark, d: O.root_info(table(spark, d, "documents").select((F.col("doc_id") % 10).alias("root")).distinct().withColumn("path", F.concat(F.lit("/root/"), F.col("root").cast("string"))), _files(spark, d)))
query(
    "time_percentiles",
    """WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events)
 SELECT event_type, count(us) AS n, round(avg(us), 2) AS mean, round(quantile_cont(us::DOUBLE, 0.5), 2) AS p50, round(quantile_cont(us::DOUBLE, 0.95), 2) AS p95, round(quantile_cont(us::DOUBLE, 0.99), 2) AS p99 FROM g WHERE us IS NOT NULL GROUP BY event_type""",
)(lambda spark, d: _gaps(table(spark, d, "events")))
query("file_totals", f"WITH {FILES} SELECT count(*) AS files, 0::BIGINT AS pending_ocr, sum(size)::BIGINT AS bytes FROM f")(lambda spark, d: O.totals(_files(spark, d)))
query("problems_page", f"WITH {FILES} SELECT path, status FROM f WHERE status IN (2, 3, 4, 5) AND contains(lower(path), 'src1') ORDER BY path LIMIT 50 OFFSET 10")(
    lambda spark, d: O.problems(_files(spark, d), None, "%SRC1_", 50, 10).select("path", "status")
)
query("flag_notes", f"WITH {FILES} SELECT doc_id, CASE status WHEN 2 THEN 'failed' WHEN 3 THEN 'truncated,encrypted' WHEN 1 THEN 'name_only' ELSE '' END AS notes FROM f")(
    lambda spark, d: _files(spark, d).select("doc_id", F.array_join(O.flag_names(F.col("flags")), ",").alias("notes"))
)


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """A snapshot and a later listing: of ten documents one is gone, one is new, one has grown and one has moved."""
    docs, k = documents(spark, d).select("doc_id", "path", (F.col("size") + 65_536).alias("size"), "mtime"), F.col("doc_id") % 10
    moved = F.concat(F.lit("/moved"), F.col("path"))
    listing = docs.filter(k != 0).select(F.when(k == 3, moved).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(k == 2, 1).otherwise(0)).alias("size"), "mtime")
    return listing, docs.filter(k != 1).select("path", "size", "mtime")


SIDES = f"""{DOCS}, l AS (SELECT CASE WHEN doc_id % 10 = 3 THEN '/moved' || path ELSE path END AS path, size + 65536 + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS size, mtime FROM d WHERE doc_id % 10 <> 0),
 s AS (SELECT path, size + 65536 AS size, mtime FROM d WHERE doc_id % 10 <> 1),
 x AS (SELECT coalesce(l.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'deleted' WHEN l.size = s.size AND l.mtime = s.mtime THEN 'same' ELSE 'changed' END AS action, l.size, s.size AS old_size, l.mtime, s.mtime AS old_mtime FROM l FULL JOIN s ON l.path = s.path)"""
query("diff_actions", f"WITH {SIDES} SELECT path, action FROM x")(lambda spark, d: O.diff(*_sides(spark, d)).select("path", "action"))
query(
    "rename_pairs",
    f"""WITH {SIDES}, a AS (SELECT path, old_size AS size, old_mtime AS mtime, row_number() OVER (PARTITION BY old_size, old_mtime ORDER BY path) AS r FROM x WHERE action = 'deleted' AND old_size >= 65536),
 b AS (SELECT path, size, mtime, row_number() OVER (PARTITION BY size, mtime ORDER BY path) AS r FROM x WHERE action = 'new' AND size >= 65536)
 SELECT a.path AS from_path, b.path AS to_path FROM a JOIN b USING (size, mtime, r)""",
)(lambda spark, d: O.rename_pairs(O.diff(*_sides(spark, d))).select("from_path", "to_path"))


@query("deleted_guarded", f"WITH {SIDES} SELECT path FROM x WHERE action = 'deleted' AND NOT starts_with(path, '/corpus/src1/') AND NOT starts_with(path, '/corpus/src2/en/')")
def deleted_guarded(spark, d):
    failed = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2/en/",)], "dir string")
    return O.guarded_deletes(O.diff(*_sides(spark, d)), failed)


query("upsert_snapshot", f"WITH {SIDES} SELECT path, size FROM l UNION ALL SELECT path, size FROM s WHERE path NOT IN (SELECT path FROM l)")(lambda spark, d: (lambda a, b: O.upsert(b, a).select("path", "size"))(*_sides(spark, d)))
query("remove_under", f"WITH {DOCS} SELECT doc_id FROM d WHERE NOT starts_with(path, '/corpus/src3/')")(lambda spark, d: O.remove(documents(spark, d), folder="/corpus/src3").select("doc_id"))
query("touch", f"WITH {SIDES} SELECT s.path, coalesce(l.size, s.size) AS size FROM s LEFT JOIN l ON s.path = l.path")(lambda spark, d: (lambda a, b: O.touch(b, a).select("path", "size"))(*_sides(spark, d)))


def _opens(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("/u/"), (F.col("user_id") % 300).cast("string")).alias("dir"), "ts", "event_type")


query("dir_hits_top", "SELECT '/u/' || (user_id % 300) AS dir, count(*) AS hits, max(ts) AS last_at FROM events GROUP BY 1 ORDER BY hits DESC, last_at DESC, dir LIMIT 200")(lambda spark, d: O.hot_dirs(_opens(spark, d)))
query(
    "debounce_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY user_id, k",
)(lambda spark, d: C.sessions(table(spark, d, "events"), "user_id", 3 * 3600))
query("storm_roots", "SELECT user_id % 20 AS root, date_trunc('day', ts) AS start, count(DISTINCT user_id) AS paths FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) > 3")(
    lambda spark, d: C.storms(table(spark, d, "events").select((F.col("user_id") % 20).alias("root"), F.col("user_id").cast("string").alias("path"), "ts"), "1 day", 3).select("root", F.col("start").cast("timestamp_ntz").alias("start"), "paths")
)
query("json_props", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")(
    lambda spark, d: table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
)
query("range_filters", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice >= 100000 AND o_totalprice < 200000")(
    lambda spark, d: table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & S.in_range("o_totalprice", (100_000, 200_000))).select("o_orderkey")
)
query("set_union", f"WITH {DOCS} SELECT doc_id FROM d WHERE {_has(' with ')} UNION SELECT doc_id FROM d WHERE {_has(' das ')}")(
    lambda spark, d: reduce(lambda a, b: a.union(b).distinct(), [S.smart(documents(spark, d), w, whole_word=True).select("doc_id") for w in ("with", "das")])
)
query("set_intersect", f"WITH {DOCS} SELECT doc_id FROM d WHERE {_has(' with ')} INTERSECT SELECT doc_id FROM d WHERE {_has(' for ')}")(
    lambda spark, d: reduce(DataFrame.intersect, [S.smart(documents(spark, d), w, whole_word=True).select("doc_id") for w in ("with", "for")])
)
query("set_except", f"WITH {DOCS} SELECT doc_id FROM d WHERE {_has(' with ')} EXCEPT SELECT doc_id FROM d WHERE {_has(' for ')}")(
    lambda spark, d: reduce(DataFrame.subtract, [S.smart(documents(spark, d), w, whole_word=True).select("doc_id") for w in ("with", "for")])
)
query("scan_requests", "SELECT DISTINCT source AS root, lang AS dir FROM documents WHERE NOT (lang <> 'en' AND source IN (SELECT source FROM documents WHERE lang = 'en'))")(lambda spark, d: _scan_requests(spark, d))


def _scan_requests(spark, d) -> DataFrame:
    """Queued scans without those that another one of the root covers ('en' stands for a parent folder)."""
    asked = table(spark, d, "documents").select(F.col("source").alias("root"), F.when(F.col("lang") != "en", F.col("lang")).alias("dir"))
    return O.scan_requests(asked).select("root", F.coalesce("dir", F.lit("en")).alias("dir"))



query(
    "head_fallback",
    """WITH h AS (SELECT doc_id, substring(text, 1, list_max(list_filter(range(0, 241), lambda i: strlen(substring(text, 1, i)) <= 240))) AS h FROM documents)
 SELECT doc_id, CASE WHEN trim(h, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN h END AS head FROM h""",
)(lambda spark, d: documents(spark, d).select("doc_id", X.head(F.col("content")).alias("head")))
query(
    "scan_summary",
    f"WITH {DOCS} SELECT count(DISTINCT parent) AS dirs, count(*) AS files, sum(size)::BIGINT AS bytes, (SELECT count(DISTINCT source) FROM documents) AS errors FROM d",
)(lambda spark, d: O.scan_summary(documents(spark, d), table(spark, d, "documents").select(F.concat(F.lit("/unread/"), "source").alias("dir"))))


@query(
    "classify_changes",
    f"""WITH {DOCS} SELECT DISTINCT doc_id % 7 AS root, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN parent ELSE '/gone' || path END AS path,
 CASE doc_id % 3 WHEN 0 THEN 'upsert' WHEN 1 THEN 'scan_dir' ELSE 'remove' END AS op FROM d""",
)
def classify_changes(spark, d):
    docs, k = documents(spark, d), F.col("doc_id") % 3
    path = F.when(k == 0, F.col("path")).when(k == 1, F.col("parent")).otherwise(F.concat(F.lit("/gone"), F.col("path")))
    there = docs.select("path", F.lit("file").alias("kind")).unionByName(docs.select(F.col("parent").alias("path"), F.lit("dir").alias("kind")).distinct())
    return C.classify(docs.select((F.col("doc_id") % 7).alias("root"), path.alias("path")), there)


_PREFIX = "then"
query(
    "ranked_prefix",
    f"""WITH {DOCS}, x AS (SELECT doc_id, f, weight, len(t) AS n, len(list_filter(t, lambda w: w = '{_PREFIX}')) AS tf, len(list_filter(t, lambda w: starts_with(w, '{_PREFIX}'))) AS hits
  FROM (SELECT doc_id, 'content' AS f, 1.0::DOUBLE AS weight, toks AS t FROM d UNION ALL SELECT doc_id, 'name', 3.0::DOUBLE, [doc_id::VARCHAR, 'txt'] FROM d) WHERE len(t) > 0),
 s AS (SELECT f, count(*) AS docs, avg(n) AS a, count_if(tf > 0) AS df FROM x GROUP BY f)
 SELECT doc_id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a)) + weight), 6) AS score FROM x JOIN s USING (f) WHERE hits > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
)(lambda spark, d: I.ranked(_index(spark, d), _PREFIX, 20))

_EXACT_SQL = r"regexp_matches(text, '(?i)and\s+the')"
query("exact_indexed", f"SELECT doc_id FROM documents WHERE {_EXACT_SQL}")(lambda spark, d: L.exact(_literals(spark, d), "and the").select("doc_id"))
query("regex_indexed", _REGEX_SQL)(lambda spark, d: L.regex(_literals(spark, d), _PATTERN).select("doc_id"))
query("names_indexed", "SELECT doc_id, CASE WHEN doc_id = 12 THEN 2 ELSE 1 END AS score FROM documents WHERE contains(doc_id || '.txt', '12') AND regexp_matches(doc_id || '.txt', '^.*2\\.txt$')")(
    lambda spark, d: L.filename(_literals(spark, d), "12 *2.txt").select("doc_id", "score")
)


def _impacts(parts: list[str], where: str, limit: int) -> str:
    """A full sort of all matches by the impacts of their words."""
    values = ", ".join(f"('{p}')" for p in parts)
    return rf"""WITH w AS (SELECT doc_id, f, unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS word
  FROM (SELECT doc_id, 'content' AS f, replace(lower(text), 'ß', 'ss') AS t FROM documents UNION ALL SELECT doc_id, 'name', doc_id || '.txt' FROM documents)),
 n AS (SELECT f, doc_id, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT f, avg(n) AS a FROM n GROUP BY f),
 l AS (SELECT doc_id, part, max(floor(100 * CASE WHEN f = 'name' THEN 2 ELSE 1 END * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / a)))::INT) AS level
  FROM (SELECT f, doc_id, word, count(*) AS tf FROM w GROUP BY ALL) JOIN n USING (f, doc_id) JOIN a USING (f), (VALUES {values}) p(part) WHERE contains(word, part) GROUP BY ALL)
 SELECT doc_id, sum(level)::DOUBLE AS score FROM l JOIN documents USING (doc_id) WHERE {where} GROUP BY doc_id HAVING count(DISTINCT part) = {len(parts)} ORDER BY score DESC, doc_id LIMIT {limit}"""


query("exact_page", _impacts(["and", "the"], _EXACT_SQL, 10))(lambda spark, d: L.exact_page(_literals(spark, d), "and the", limit=10)[0])
query("regex_page", _impacts(["then", "ing"], f"regexp_matches(text, '(?i){_PATTERN}')", 10))(lambda spark, d: L.regex_page(_literals(spark, d), _PATTERN, limit=10)[0])
query("regex_scripts", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:^|[^\p{L}\p{M}\p{N}_])[\p{L}\p{M}\p{N}_]é[\p{L}\p{M}\p{N}_]+')")(
    lambda spark, d: regex_scan(documents(spark, d), r"\b\wé[\w]+\b").select("doc_id")
)
query(
    "regex_spans",
    f"SELECT doc_id, len(regexp_extract_all(text, '(?i){_PATTERN}'))::INT AS matches, strpos(text, regexp_extract(text, '(?i){_PATTERN}')) - 1 AS first FROM documents WHERE regexp_matches(text, '(?i){_PATTERN}')",
)(lambda spark, d: _spans(documents(spark, d), "regex", _PATTERN))
query(
    "exact_spans",
    r"SELECT doc_id, len(regexp_extract_all(text, '(?i)and\s+the'))::INT AS matches, strpos(text, regexp_extract(text, '(?i)and\s+the')) - 1 AS first FROM documents WHERE regexp_matches(text, '(?i)and\s+the')",
)(lambda spark, d: _spans(documents(spark, d), "exact", "and the"))


def _spans(docs: DataFrame, mode: str, text: str) -> DataFrame:
    found = H.shown(docs, H.highlighter(mode, text), "spans", keys=("doc_id",)).filter(F.size("spans") > 0)
    return found.select("doc_id", F.size("spans").alias("matches"), F.col("spans")[0]["start"].cast("long").alias("first"))


def _event_changes(events: DataFrame) -> DataFrame:
    """Events as changes of files: errors remove a file, purchases rename one, the others write one."""
    folder, k = F.concat(F.lit("/u/"), (F.col("user_id") % 40).cast("string"), F.lit("/")), F.col("event_id")
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "rename").otherwise("upsert")
    name = lambda n: F.concat(folder, (n % 9).cast("string"))
    return events.select((F.col("user_id") % 40).alias("root"), name(k).alias("path"), op.alias("op"), F.when(op == "rename", name(k * 7)).alias("from_path"), F.when(op == "upsert", k + 1).alias("size"), F.when(op == "upsert", k).alias("mtime"), F.col("ts").cast("timestamp").alias("ts"), k.alias("seq"))


_FOLD = """WITH RECURSIVE e AS (SELECT event_id AS id, ts, '/u/' || (user_id % 40) || '/' AS u, CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'rename' ELSE 'upsert' END AS op FROM events),
 c AS (SELECT id, ts, op, u || (id % 9) AS path, u || (id * 7 % 9) AS from_path, CASE WHEN op = 'upsert' THEN id + 1 END AS size, CASE WHEN op = 'upsert' THEN id END AS mtime FROM e WHERE op <> 'rename' OR id % 9 <> id * 7 % 9),
 t AS (SELECT id, ts, op, path AS place, op <> 'remove' AS filled FROM c UNION ALL SELECT id, ts, op, from_path, false FROM c WHERE op = 'rename'),
 p AS (SELECT *, lag(id) OVER w AS b, lag(filled) OVER w AS bf FROM t WINDOW w AS (PARTITION BY place ORDER BY ts, id)),
 src AS (SELECT id, place AS origin, b, bf FROM p WHERE op = 'rename' AND NOT filled),
 fin AS (SELECT place AS path, id, filled FROM t QUALIFY row_number() OVER (PARTITION BY place ORDER BY ts DESC, id DESC) = 1),
 walk(path, cur, size, mtime, origin) AS (SELECT fin.path, id, size, mtime, NULL::VARCHAR FROM fin JOIN c USING (id) WHERE filled
  UNION ALL SELECT w.path, CASE WHEN bf THEN b END, coalesce(w.size, c.size), coalesce(w.mtime, c.mtime), CASE WHEN b IS NULL THEN s.origin END FROM walk w JOIN src s ON s.id = w.cur LEFT JOIN c ON bf AND c.id = s.b),
 f AS (SELECT fin.path, CASE WHEN NOT filled THEN 'remove' WHEN origin IS NOT NULL THEN 'move' ELSE 'upsert' END AS op, origin AS from_path, size, mtime
  FROM fin LEFT JOIN (SELECT * FROM walk WHERE cur IS NULL OR cur NOT IN (SELECT id FROM src)) w USING (path))"""
query("fold_changes", f"{_FOLD} SELECT path, op, from_path, size, mtime FROM f")(lambda spark, d: C.fold(_event_changes(table(spark, d, "events"))).select("path", "op", "from_path", "size", "mtime"))


@query("stream_changes", f"{_FOLD} SELECT path, size, mtime FROM f WHERE op = 'upsert'")
def stream_changes(spark, d):
    """The events read as a stream from their table, applied to a store; what the store then holds."""
    register(spark)
    table(spark, d, "events")  # sends the package to the executors
    where = shared_folder(spark, "changes")
    events = spark.readStream.format(SOURCE).option("path", f"{d}/events.parquet").option("state", f"{where}/state").load()
    store = Store(spark, f"{where}/store")
    run = _event_changes(events).writeStream.foreachBatch(C.into_store(store)).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.table("files").select("path", "size", "mtime")


@query("gathered_changes", f"{_FOLD} SELECT path, size, mtime FROM f WHERE op = 'upsert'")
def gathered_changes(spark, d):
    """The events read in batches of a bounded size, which a policy commits together; what the store then holds."""
    register(spark)
    table(spark, d, "events")  # sends the package to the executors
    where = shared_folder(spark, "gathered")
    events = spark.readStream.format(SOURCE).option("path", f"{d}/events.parquet").option("state", f"{where}/state").option("bytesPerBatch", 64 << 20).load()
    store = Store(spark, f"{where}/store")
    waiting = C.Gathering(store, f"{where}/waiting")
    run = _event_changes(events).writeStream.foreachBatch(waiting).option("checkpointLocation", f"{where}/checkpoint").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    waiting.finish()
    return store.table("files").select("path", "size", "mtime")


query(
    "lost_changes",
    f"""WITH {SIDES}, a AS (SELECT path, old_size AS size, old_mtime AS mtime, row_number() OVER (PARTITION BY old_size, old_mtime ORDER BY path) AS r FROM x WHERE action = 'deleted' AND NOT starts_with(path, '/corpus/src1/')),
 b AS (SELECT path, size, mtime, row_number() OVER (PARTITION BY size, mtime ORDER BY path) AS r FROM x WHERE action = 'new'), m AS (SELECT a.path AS from_path, b.path, b.size, b.mtime FROM a JOIN b USING (size, mtime, r))
 SELECT path, 'rename' AS op, from_path, size FROM m UNION ALL SELECT path, 'upsert', NULL, size FROM x WHERE action IN ('new', 'changed') AND path NOT IN (SELECT path FROM m)
 UNION ALL SELECT path, 'remove', NULL, NULL FROM a WHERE path NOT IN (SELECT from_path FROM m)""",
)(lambda spark, d: (lambda listing, old: C.lost_changes(old, listing, spark.createDataFrame([("/corpus/src1",)], "dir string")).select("path", "op", "from_path", "size"))(*_sides(spark, d)))


query("content_copies", "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1")(lambda spark, d: K.copies(documents(spark, d)))


@query("content_index", f"WITH {DOCS} SELECT doc_id FROM d WHERE {_has(' with')} AND NOT {_has(' for')}")
def content_index(spark, d):
    """A search over postings of distinct texts."""
    where = _written(spark, d, "contents", lambda docs, at: K.Contents(spark, at).add(docs))
    return K.Contents(spark, where).index(documents(spark, d)).matches("with -for")


def _texts(spark: SparkSession, sf_dir: str) -> str:
    return _written(spark, sf_dir, "texts", P.write)


@query("text_page", f"WITH {DOCS} SELECT doc_id, path, sha256(text) AS hash, strlen(text) AS bytes FROM d WHERE {_has(' with')} ORDER BY mtime DESC, doc_id LIMIT 200")
def text_page(spark, d):
    """A page of hits with their texts, read by key from the table of texts."""
    page = _index(spark, d).matches("with").join(documents(spark, d).select("doc_id", "path", "mtime"), "doc_id").orderBy(F.desc("mtime"), "doc_id").limit(200)
    return P.with_texts(page, _texts(spark, d)).select("doc_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "bytes")


def _old_store(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of an older version, the catalog and the stored texts: of ten documents the catalog has lost one, one text is
    not stored, and long ones were cut."""
    docs, k = documents(spark, d), F.col("doc_id") % 10
    text = docs.filter(k != 4).select("path", "content", (F.col("size") > 1500).alias("cut"))
    return docs, _files(spark, d).filter(k != 6), text


MIGRATION = f"""{FILES}, m AS (SELECT d.doc_id, d.path, CASE WHEN f.dir = '/corpus/src1/en/' THEN 'container' WHEN status NOT IN (0, 4) THEN 'no_content' WHEN d.doc_id % 10 = 4 THEN 'not_stored' WHEN d.size > 1500 THEN 'cut' ELSE 'stored' END AS reason,
 d.text, f.size, f.mtime FROM d JOIN f ON d.path = f.path AND d.doc_id % 10 <> 6)"""


def _migration(spark, d) -> DataFrame:
    return G.plan(*_old_store(spark, d), container=F.col("dir") == "/corpus/src1/en/")


query("migration_plan", f"WITH {MIGRATION} SELECT path, CASE WHEN reason IN ('stored', 'no_content') THEN 'rebuild' ELSE 'read' END AS action, reason FROM m")(lambda spark, d: _migration(spark, d).select("path", "action", "reason"))


@query("migrated_documents", f"WITH {MIGRATION} SELECT doc_id, size, mtime, CASE WHEN reason = 'stored' THEN sha256(text) END AS hash FROM m WHERE reason IN ('stored', 'no_content')")
def migrated_documents(spark, d):
    old, _, texts = _old_store(spark, d)
    return G.rebuilt(old, _migration(spark, d), texts).select("doc_id", "size", "mtime", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@query(
    "stage_measures",
    f"""WITH {DOCS}, m AS (SELECT size, {_has(' with')} AS hit FROM d)
 SELECT 'read' AS stage, count(*) AS rows, coalesce(sum(size), 0)::BIGINT AS bytes FROM m UNION ALL SELECT 'matched', count(*), coalesce(sum(size), 0)::BIGINT FROM m WHERE hit
 UNION ALL SELECT 'large', count(*), coalesce(sum(size), 0)::BIGINT FROM m WHERE hit AND size > 1500""",
)
def stage_measures(spark, d):
    """A search run once, and what each of its stages has let through."""
    m = Measures()
    found = m.stage("matched", S.smart(m.stage("read", documents(spark, d), "size"), "with"), "size")
    m.stage("large", found.filter("size > 1500"), "size").select("doc_id").write.format("noop").mode("overwrite").save()
    return m.table(spark)


def _boxes(spark, d) -> DataFrame:
    """Messages as members: of four archives one is named in capitals, one is no archive, and one has names for numbers."""
    k, turn = F.col("conv_id") % 4, F.col("turn").cast("string")
    path = F.concat(F.lit("/mail/"), F.col("conv_id").cast("string"), F.when(k == 1, ".PST/#").when(k == 2, ".zip/#").when(k == 3, ".pst/#n").otherwise(".pst/#"), turn)
    return table(spark, d, "conversations").select("conv_id", "turn", path.alias("path"), F.octet_length("text").cast("long").alias("size"))


BOXES = "b AS (SELECT conv_id, turn, '/mail/' || conv_id || CASE conv_id % 4 WHEN 1 THEN '.PST/#' WHEN 2 THEN '.zip/#' WHEN 3 THEN '.pst/#n' ELSE '.pst/#' END || turn AS path, strlen(text) AS size FROM conversations)"
query("member_paths", f"WITH {BOXES} SELECT path, CASE WHEN conv_id % 4 < 2 THEN '/mail/' || conv_id || CASE conv_id % 4 WHEN 1 THEN '.PST' ELSE '.pst' END END AS container, CASE WHEN conv_id % 4 < 2 THEN turn END AS number FROM b")(
    lambda spark, d: _boxes(spark, d).select("path", M.split_member(F.col("path")).alias("m")).select("path", "m.container", "m.number")
)


@query("replaced_members", f"WITH {BOXES} SELECT path, size FROM b WHERE conv_id % 8 <> 0 UNION ALL SELECT path, size + 1 FROM b WHERE conv_id % 8 = 0 AND turn % 2 = 0")
def replaced_members(spark, d):
    """Archives that were read again and had fewer messages then."""
    files = _boxes(spark, d)
    again = files.filter("conv_id % 8 = 0")
    fresh = again.filter("turn % 2 = 0").select("path", (F.col("size") + 1).alias("size"))
    return M.replace_members(files.select("path", "size"), fresh, again.select(M.split_member(F.col("path"))["container"].alias("path")))
