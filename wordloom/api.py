"""Building, saving, loading and searching an index."""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stopwords as stop
from .operators import filters, index, search
from .operators.prepare import last_wins, map_meta, with_ids

FORMAT = 1


class StorageError(ValueError):
    """A folder that holds no index that this version reads."""


class IndexKind(Enum):
    EXACT = "exact"
    XOR8 = "xor8"

    @classmethod
    def parse(cls, name: str) -> IndexKind:
        try:
            return {"exact": cls.EXACT, "xor": cls.XOR8, "xor8": cls.XOR8}[name.lower()]
        except KeyError:
            raise ValueError(f"unknown index kind {name!r}: exact, xor or xor8") from None

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Index:
    """docs, and postings (exact) or filters (xor8)."""

    kind: IndexKind
    docs: DataFrame
    data: DataFrame

    def search(self, query: str, n: int = 5) -> DataFrame:
        """(rank, score, doc_id, title, url, meta)."""
        find = search.search if self.kind is IndexKind.EXACT else lambda d, f, q, n: filters.search_filter(f, q, n)
        best = find(self.docs, self.data, query, n)
        # n rows at most
        return F.broadcast(best).join(self.docs.select("doc_id", "title", "url", "meta"), "doc_id").select("rank", "score", "doc_id", "title", "url", "meta").orderBy("rank")

    def search_many(self, queries: DataFrame, n: int = 5) -> DataFrame:
        """(query_id, rank, doc_id, score) of queries (query_id, query)."""
        if self.kind is not IndexKind.EXACT:
            raise ValueError("a filter index answers one query at a time")
        return search.search_many(self.docs, self.data, queries, n)

    def count(self) -> int:
        return self.docs.count()

    def is_empty(self) -> bool:
        return self.docs.isEmpty()

    def persist(self) -> Index:
        """Keeps both tables in memory for many searches."""
        return replace(self, docs=self.docs.persist(), data=self.data.persist())

    def search_json(self, query: str | None, n: int = 5) -> DataFrame:
        """One row: the hits as a JSON array by rank, null for a null query."""
        hits = self.search(query or "", n)
        text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "meta"))), lambda h: F.struct(h["title"].alias("title"), h["url"].alias("url"), h["meta"].alias("meta"))))
        return hits.agg((text if query is not None else F.lit(None).cast("string")).alias("json"))

    def search_lines(self, query: str, n: int = 5) -> DataFrame:
        return self.search(query, n).select("rank", F.format_string("Title: %s, Url: %s, Meta: %s", "title", "url", "meta").alias("line"))

    def save(self, path: str, stopwords: Iterable[str] = ()) -> None:
        """Parquet tables and, last of all, a manifest."""
        spark = self.docs.sparkSession
        self.docs.write.parquet(f"{path}/docs")
        data = index.sorted_layout(self.data) if self.kind is IndexKind.EXACT else self.data
        data.write.parquet(f"{path}/data")
        if self.kind is IndexKind.EXACT:
            index.check(spark.read.parquet(f"{path}/data"))
        manifest = {"format": FORMAT, "kind": str(self.kind), "docs": spark.read.parquet(f"{path}/docs").count(), "stopwords": hashlib.sha256(" ".join(sorted(stopwords)).encode()).hexdigest()}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, check: bool = True) -> Index:
        """check: that the tables hold as many documents as were saved, and lists that keep the rules."""
        try:
            manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
            kind = IndexKind.parse(manifest["kind"])
            if manifest["format"] != FORMAT:
                raise StorageError(f"format {manifest['format']}")
        except StorageError:
            raise
        except Exception as e:
            raise StorageError(f"{path} holds no index: {e}") from e
        found = Index(kind, spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/data"))
        if check:
            if (n := found.count()) != manifest["docs"]:
                raise StorageError(f"{path} holds {n} documents of {manifest['docs']}")
            if kind is IndexKind.EXACT:
                try:
                    index.check(found.data)
                except index.MalformedIndex as e:
                    raise StorageError(f"{path}: {e}") from e
        return found

    @staticmethod
    def from_filters(rows: DataFrame) -> Index:
        """From rows (doc_id, title, url, meta, title_terms, filter)."""
        return Index(IndexKind.XOR8, rows.select("doc_id", "title", "url", "meta"), rows)

    @staticmethod
    def empty(spark: SparkSession) -> Index:
        docs = spark.createDataFrame([], "doc_id bigint, title string, url string, meta string, body string")
        return ExactBackend().build(index.document_terms(docs))


class Backend(ABC):
    """From document terms (doc_id, title, url, meta, title_terms, terms) to an index."""

    @abstractmethod
    def build(self, docs: DataFrame) -> Index: ...


class ExactBackend(Backend):
    def build(self, docs: DataFrame) -> Index:
        return Index(IndexKind.EXACT, docs.drop("terms"), index.build_postings(index.posting_terms(docs)))


class FilterBackend(Backend):
    def build(self, docs: DataFrame) -> Index:
        return Index.from_filters(filters.build_filters(docs))


BACKENDS: dict[IndexKind, Backend] = {IndexKind.EXACT: ExactBackend(), IndexKind.XOR8: FilterBackend()}


@dataclass(frozen=True)
class SearchEngine:
    """SearchEngine().with_stopwords([...]).with_index_kind(IndexKind.XOR8).build(posts)."""

    stopwords: tuple[str, ...] = stop.ENGLISH
    kind: IndexKind = IndexKind.EXACT

    def with_stopwords(self, words: Iterable[str]) -> SearchEngine:
        """Replaces the built-in words; none at all turns the filter off."""
        return replace(self, stopwords=tuple(sorted(set(words))))

    def with_index_kind(self, kind: IndexKind | str) -> SearchEngine:
        return replace(self, kind=IndexKind.parse(kind) if isinstance(kind, str) else kind)

    def prepare(self, posts: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
        """Posts with columns title, url, body, meta (text or a map), or those that mapping names for
        them: one row a (title, url, meta), the last by pos where there is one, with a doc_id."""
        at = {c: (mapping or {}).get(c, c) for c in ("title", "url", "body", "meta")}
        kinds = dict(posts.dtypes)
        meta = F.col(at["meta"]) if at["meta"] in kinds else F.lit("")
        if kinds.get(at["meta"], "").startswith("map"):
            meta = map_meta(meta)
        body = F.col(at["body"]) if at["body"] in kinds else F.lit(None).cast("string")
        keys = [c for c in ("doc_id", "pos") if c in kinds]
        out = posts.select(*keys, F.coalesce(at["title"], F.lit("")).alias("title"), F.coalesce(at["url"], F.lit("")).alias("url"), F.coalesce(meta, F.lit("")).alias("meta"), body.alias("body"))
        if "pos" in keys:
            out = last_wins(out, "pos").drop("pos")
        elif "doc_id" not in keys:
            out = out.groupBy("title", "url", "meta").agg(F.max("body").alias("body"))
        return out if "doc_id" in keys else with_ids(out)

    def build(self, posts: DataFrame, mapping: dict[str, str] | None = None) -> Index:
        return self.build_with(posts, BACKENDS[self.kind], mapping)

    def build_with(self, posts: DataFrame, backend: Backend, mapping: dict[str, str] | None = None) -> Index:
        return backend.build(index.document_terms(self.prepare(posts, mapping), self.stopwords))
