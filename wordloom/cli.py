"""python -m wordloom.cli index POSTS.json OUT | search OUT WORDS... """

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .api import Index, SearchEngine
from .functions import stopwords as stop
from .operators.prepare import project
from .sources.json_posts import read_fields
from .sources.schema import load_schema


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wordloom", description=__doc__)
    parser.add_argument("--version", action="version", version="wordloom 0.1")
    modes = parser.add_subparsers(dest="mode", required=True)
    build = modes.add_parser("index", help="build an index from a JSON array; wordloom.toml beside it may hold a schema")
    build.add_argument("posts")
    build.add_argument("out")
    build.add_argument("--indexer", default="exact", help="exact, xor or xor8")
    build.add_argument("--stopwords", help="a file of words that replace the built-in ones")
    find = modes.add_parser("search")
    find.add_argument("index")
    find.add_argument("words", nargs="+")
    find.add_argument("-N", "--num-searches", type=int, default=5)
    find.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("wordloom").getOrCreate()
    if a.mode == "index":
        words = stop.load(a.stopwords) if a.stopwords else stop.ENGLISH
        posts = project(read_fields(spark, a.posts), load_schema(os.path.dirname(os.path.abspath(a.posts))))
        SearchEngine().with_stopwords(words).with_index_kind(a.indexer).build(posts).save(a.out, words)
        return
    found = Index.load(spark, a.index)
    query = " ".join(a.words)
    if a.json:
        print(found.search_json(query, a.num_searches).first().json)
    else:
        for row in found.search_lines(query, a.num_searches).orderBy("rank").collect():
            print(row.line)


if __name__ == "__main__":
    main()
