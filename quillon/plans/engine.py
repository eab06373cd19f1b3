"""The engine: roots, scans into snapshots, searches, snippets, previews, problems and status over one store."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..operators import files as O
from ..operators import migrate
from ..operators.store import SCHEMA_VERSION, Store
from ..sources.readers import extracted
from ..sources.scan import Filter, kind, scan
from . import highlight as H
from . import index as I
from . import scan as S
from .regex import regex_scan, required_literals

MOST_ROWS, RESULT_LIMIT, MOST_PATHS = 500, 10_000, 200
#: Tables that grow by segments, in step.
SEGMENTED = ("documents", "postings", "lengths")
CODES = {name: code for code, name in O.STATUS.items()}


@dataclass
class Request:
    query: str = ""
    mode: str = "smart"  # smart, exact, regex, filename
    case_sensitive: bool = False
    whole_word: bool = False
    filters: dict = field(default_factory=dict)
    sort: str = "relevance"  # relevance, modified, size, name
    offset: int = 0
    limit: int = 100


@dataclass
class Response:
    items: list
    total: int
    total_is_lower_bound: bool
    strategy: str
    warnings: list
    generation: int
    elapsed_ms: float


class Engine:
    def __init__(self, spark: SparkSession, where: str, keep: Filter | None = None):
        self.spark, self.store, self.keep = spark, Store(spark, where), keep or Filter()

    def roots(self) -> list[str]:
        t = self.store.table("roots")
        return [] if t is None else [r.path for r in t.orderBy("path").collect()]

    def add_root(self, path: str) -> list[str]:
        """A root inside another is refused; a root takes over those inside it."""
        path, now = T.filter_form(path).rstrip("/"), self.roots()
        if any((path + "/").startswith(r + "/") for r in now):
            raise Q.QueryError("the folder is covered already")
        self._commit_roots([r for r in now if not r.startswith(path + "/")] + [path])
        return self.roots()

    def remove_root(self, path: str) -> None:
        self._commit_roots([r for r in self.roots() if r != path])
        docs = self._live("documents")
        if docs is not None:
            gone = docs.filter(F.startswith("path", F.lit(path + "/"))).select("doc_id")
            self.store.commit(keep={"gone": len(self.store.segments("gone"))}, gone=gone)

    def _commit_roots(self, paths: list[str]) -> None:
        self.store.commit(roots=self.spark.createDataFrame([(p,) for p in sorted(paths)], "path string"))

    def _live(self, name: str) -> DataFrame | None:
        """A table without the rows of documents that are gone or were replaced."""
        rows, gone = self.store.table(name), self.store.table("gone")
        return rows if rows is None or gone is None else rows.join(gone, "doc_id", "left_anti")

    def _draft(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.store.draft(name, df))

    def rescan(self, failed_dirs: DataFrame | None = None) -> dict[str, int]:
        """Lists all roots, reads what is new or changed, and adds it and its postings as one segment; what is gone or
        changed is marked. Nothing that stayed the same is read or written. Counts by action.

        Files of ``failed_dirs`` (column dir) and of roots that cannot be listed are not taken as deleted. A large file that
        was moved under the same extension keeps its text. Documents and index become visible together.
        """
        listing, lost = None, []
        for r in self.roots():
            try:
                part = scan(self.spark, r, self.keep)
            except AnalysisException:
                lost.append(r)
                continue
            listing = part if listing is None else listing.unionByName(part)
        if listing is None:
            return {"unreadable": len(lost)} if lost else {}
        old = self._live("documents")
        seen = self._draft("listing", listing.drop("content"))
        known = old if old is not None else self.spark.createDataFrame([], "path string, size long, mtime long")
        changes = self._draft("changes", O.diff(seen.select("path", "size", "mtime"), known.select("path", "size", "mtime")))
        counts = {r["action"]: r["n"] for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}  # a row for each action
        if lost:
            counts["unreadable"] = len(lost)
        if not counts.keys() & {"new", "changed", "deleted"}:
            return counts
        work = changes.filter("action IN ('new', 'changed')").select("path")
        moved = None
        if old is not None:
            failed = self.spark.createDataFrame([(r,) for r in lost], "dir string")
            if failed_dirs is not None:
                failed = failed.unionByName(failed_dirs.select("dir"))
            deleted = O.guarded_deletes(changes, failed)
            sure = changes.join(deleted, "path", "left_semi").unionByName(changes.filter("action = 'new'"))
            pairs = O.rename_pairs(sure).select("from_path", F.col("to_path").alias("path"))
            texts = old.select(F.col("path").alias("from_path"), F.col("ext").alias("__ext"), *[c for c in old.columns if c not in seen.columns and c != "doc_id"])
            moved = self._draft("moved", seen.join(pairs, "path").join(texts, "from_path").filter("ext = __ext").drop("__ext", "from_path"))
            work = work.join(moved.select("path"), "path", "left_anti")
            left = deleted.unionByName(changes.filter("action = 'changed'").select("path"))
            gone = self._draft("gone", old.join(left, "path", "left_semi").select("doc_id"))
            if not counts.keys() & {"new", "changed"}:  # nothing to read: marks alone, if a deletion is sure
                if not gone.isEmpty():
                    self.store.commit(keep={"gone": len(self.store.segments("gone"))}, gone=self.store.drafted("gone"))
                return counts
        fresh = extracted(listing.join(work, "path", "left_semi")).withColumn("kind", kind(F.col("ext")))
        fresh = fresh.withColumn("flags", F.when(F.col("truncated"), 1).otherwise(0).cast("long")).drop("truncated")
        code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
        fresh = fresh.withColumn("status", code[F.col("status")].cast("int"))
        docs = fresh if moved is None else fresh.unionByName(moved.select(*fresh.columns))
        new = {"documents": self.store.draft("documents", docs.withColumn("doc_id", version_id(self.store.manifest()["generation"] + 1)))}
        new |= self._indexed(I.postings(self.spark.read.parquet(new["documents"])))
        if old is not None:
            new["gone"] = self.store.drafted("gone")
        self.store.commit(keep={name: len(self.store.segments(name)) for name in new}, **new)
        self.merge()
        return counts

    def _indexed(self, posts: DataFrame) -> dict[str, str]:
        at = self.store.draft("postings", posts.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"))
        return {"postings": at, "lengths": self.store.draft("lengths", I.lengths(self.spark.read.parquet(at)))}

    def merge(self) -> int:
        """Makes one segment of the last ones while the one before has at most twice their bytes; returns how many.

        So each segment is over twice as large as all after it: their number, and how often a row is written, grow with the
        logarithm of the data. Rows of documents that are gone are left out, and so are their marks.
        """
        at = {name: self.store.segments(name) for name in SEGMENTED}
        sizes = [self.store.bytes(p) for p in at["documents"]]
        k = len(sizes) - 1
        while k > 0 and sizes[k - 1] <= 2 * sum(sizes[k:]):
            k -= 1
        if len(sizes) - k < 2:
            return 0
        gone = self.store.table("gone")
        last = {name: self.spark.read.parquet(*paths[k:]) for name, paths in at.items()}
        live = {name: df if gone is None else df.join(gone, "doc_id", "left_anti") for name, df in last.items()}
        new = {name: self.store.draft(name, live[name]) for name in ("documents", "lengths")}
        new["postings"] = self.store.draft("postings", live["postings"].repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id"))
        if gone is not None:
            new["gone"] = self.store.draft("gone", gone.join(last["documents"].select("doc_id"), "doc_id", "left_anti"))
        self.store.commit(keep=dict.fromkeys(SEGMENTED, k), **new)
        return len(sizes) - k

    def documents(self) -> DataFrame:
        docs = self._live("documents")
        if docs is None:
            raise Q.QueryError("nothing is indexed")
        return docs

    def index(self) -> I.Index:
        docs = self.documents().select("doc_id", *[c for c in ("path", "parent", "dir", "name", "name_lc", "ext", "kind", "size", "mtime") if c in self.documents().columns])
        return I.Index(docs, self._live("postings"), self._live("lengths"))

    def _matches(self, r: Request) -> tuple[DataFrame, str, list]:
        docs, warnings = self.documents(), []
        if r.filters:
            docs = docs.filter(S.ui_filters(**r.filters))
        if r.mode == "exact":
            return S.exact(docs, r.query, r.case_sensitive, r.whole_word), "verified", warnings
        if r.mode == "regex":
            if not required_literals(Q.split_filters(r.query)[1]):
                warnings.append("the pattern has no fixed part: all texts are read")
            return regex_scan(docs, r.query, r.case_sensitive, r.whole_word), "scan", warnings
        if r.mode == "filename":
            names = S.filename(docs, r.query)
            return names.withColumn("score", S.name_score(Q.split_filters(r.query)[1].split()).cast("double")), "indexed", warnings
        if r.case_sensitive and S.needed(Q.parse(r.query)):
            return S.smart(docs, r.query, r.whole_word, True), "verified", warnings
        hits = self.index().scored(r.query, whole_word=r.whole_word) if r.sort == "relevance" else self.index().matches(r.query, r.whole_word)
        return docs.join(hits, "doc_id"), "indexed", warnings

    def search(self, r: Request) -> Response:
        """One page of matches and their exact number, which is reported up to RESULT_LIMIT."""
        began = time.time()
        limit = max(1, min(r.limit, MOST_ROWS))
        hits, strategy, warnings = self._matches(r)
        narrow = ["doc_id", "path", "name", "name_lc", F.col("parent").alias("dir"), "ext", "kind", "size", "mtime", "flags", "title"]
        hits = hits.select(*narrow, *([] if "score" not in hits.columns else ["score"]))
        order = {"modified": [F.desc("mtime")], "size": [F.desc("size")], "name": [F.col("name_lc")]}.get(r.sort, [F.desc("score")] if "score" in hits.columns else [])
        if "score" not in hits.columns:
            hits = hits.withColumn("score", F.lit(0.0))
        if r.offset >= RESULT_LIMIT:
            rows, total = [], hits.count()
        else:  # the count is observed on the way to the page
            seen = Observation()
            rows = hits.observe(seen, F.count(F.lit(1)).alias("total")).orderBy(*order, "doc_id").offset(r.offset).limit(limit).drop("name_lc").collect()
            total = seen.get["total"]
        return Response(rows, min(total, RESULT_LIMIT), total > RESULT_LIMIT, strategy, warnings, self.store.manifest()["generation"], (time.time() - began) * 1000)

    def _some(self, paths: list[str]) -> DataFrame:
        """The documents of a page of paths."""
        if len(paths) > MOST_PATHS:
            raise Q.QueryError(f"at most {MOST_PATHS} paths at once")
        return self.documents().filter(F.col("path").isin(*paths)).select("path", "content", "anchors")

    def _marks(self, r: Request) -> H.Highlighter:
        return H.highlighter(r.mode, r.query, r.case_sensitive, r.whole_word)

    def snippets(self, r: Request, paths: list[str]) -> dict[str, dict]:
        """Snippets of at most 200 files, made where the texts are; where a text has no match, its head."""
        return {x.path: x.snippets.asDict(True) for x in H.shown(self._some(paths), self._marks(r)).collect()}

    def preview(self, r: Request, path: str) -> dict | None:
        rows = H.shown(self._some([path]), self._marks(r), "preview").collect()
        return rows[0].preview.asDict(True) if rows else None

    def is_indexed(self, path: str) -> bool:
        return not self.documents().filter(F.col("path") == path).isEmpty()

    def problems(self, status: int | None = None, contains: str = "", limit: int = 100, offset: int = 0) -> list:
        return O.problems(self.documents().select("path", "status", "reason"), status, contains, limit, offset).collect()

    def status(self) -> dict:
        docs = self.documents()
        counts = {r.status: r.n for r in O.status_counts(docs).collect()}
        return {"files": sum(n for s, n in counts.items() if s != CODES["ignored"]), "by_status": {O.STATUS[s]: n for s, n in counts.items()}, "generation": self.store.manifest()["generation"]}

    def sizes(self) -> dict[str, int]:
        """Bytes of each table."""
        return self.store.sizes()

    def rebuild(self) -> None:
        """One segment, its index anew from the stored texts."""
        docs = self.store.draft("documents", self.documents())
        new = {"documents": docs} | self._indexed(I.postings(self.spark.read.parquet(docs)))
        self.store.commit(gone=self.spark.createDataFrame([], "doc_id long"), **new)

    def upgrade(self, done: Callable[[dict[str, int]], None] | None = None) -> dict[str, int]:
        """Takes over a store of an older version: the index is made anew from the stored texts, and files whose text was cut
        are taken as changed by the next scan. Nothing is visible until all is there, so one that was stopped begins again.
        Returns how many documents were rebuilt and how many wait for the scan, and hands that to ``done``; a store of this
        version stays as it is and gives nothing."""
        docs = self._live("documents")
        if docs is None or self.store.manifest()["version"] == SCHEMA_VERSION:
            return {}
        cut = F.col("flags").bitwiseAND(F.lit(O.FLAGS["truncated"])) != 0
        planned = self._draft("planned", migrate.plan(docs, docs, docs.filter("content IS NOT NULL").select("path", cut.alias("cut"))))
        new = self.store.draft("documents", migrate.to_read(docs, planned))
        self.store.commit(gone=self.spark.createDataFrame([], "doc_id long"), documents=new, **self._indexed(I.postings(self.spark.read.parquet(new))))
        counts = {r.action: r.n for r in planned.groupBy("action").agg(F.count("*").alias("n")).collect()}  # two rows at most
        out = {"rebuilt": counts.get("rebuild", 0), "read": counts.get("read", 0)}
        if done:
            done(out)
        return out


def version_id(generation: int) -> Column:
    """A number for each row that is written in a generation, used once: 19 bits for the generation, 20 for the task, 24 for
    the row in it. Beyond them it is an error."""
    task, row = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fits = (task < 1 << 20) & (row < 1 << 24) & F.lit(generation < 1 << 19)
    return F.when(fits, F.lit(generation << 44) + F.shiftleft(task, 24) + row).otherwise(F.raise_error(F.lit("too many rows for the numbers of a generation")).cast("long"))
