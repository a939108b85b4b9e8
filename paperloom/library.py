"""A library of parsed documents and the commands over it: find a document by name, select, search, summarise, export.

    lib = Library(documents, blocks, cells)
    lib.run('search report.pdf "net total" --page 1-3').show()

Every command returns a DataFrame and reads only what it needs; documents are found by filters, so nothing is collected but the few
names that a misspelt or ambiguous one calls for.
"""

from __future__ import annotations

import argparse
import re
import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import blocks as B
from paperloom.operators import output as O
from paperloom.operators import relations as R
from paperloom.operators import summaries as S

ID = r"^[0-9a-f]{12}$"
SHOWN = 5


class CommandError(ValueError):
    """What the user got wrong, with a hint."""


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise CommandError(message)


def suggestion(spark, word: str, known: list[str]) -> str | None:
    """The known word with the smallest edit distance under three; ties go to the first in the alphabet."""
    rows = spark.createDataFrame([(k,) for k in known], "word string").withColumn("d", F.levenshtein(F.lit(word), "word"))
    best = rows.filter("d < 3").orderBy("d", "word").first()
    return best and best["word"]


class Library:
    """Documents (document_id, filename, format, page_count, status, ts), blocks and cells (document_id, ...)."""

    KEY = "document_id"

    def __init__(self, documents: DataFrame, blocks: DataFrame, cells: DataFrame):
        self.documents, self.blocks, self.cells = documents, blocks, cells
        self.current: str | None = None
        self.history: list[str] = []
        self.commands: dict[str, Callable[[argparse.Namespace], DataFrame]] = {
            "docs": self._docs, "use": self._use, "status": self._status, "text": self._text, "tables": self._tables, "search": self._search, "summary": self._summary,
            "markdown": self._markdown, "json": self._json, "export": self._export, "pdf": self._pages, "equations": self._of("equation"), "charts": self._of("chart"), "figures": self._of("figure"),
        }

    def run(self, line: str) -> DataFrame:
        words = shlex.split(line)
        if not words:
            raise CommandError("no command")
        name, rest = words[0].lower(), words[1:]
        if name not in self.commands:
            near = suggestion(self.documents.sparkSession, name, list(self.commands))
            raise CommandError(f"unknown command {name!r}" + (f", did you mean {near!r}?" if near else ""))
        self.history.append(line)
        return self.commands[name](self._parser(name).parse_args(rest))

    @staticmethod
    def complete(known: list[str], start: str) -> list[str]:
        return sorted(k for k in known if k.startswith(start.lower()))

    def _parser(self, name: str) -> argparse.ArgumentParser:
        p = _Parser(prog=name, add_help=False)
        if name == "export":
            p.add_argument("format", choices=["json", "md", "txt", "csv"])
        p.add_argument("file", nargs="?", default="")
        if name == "search":
            p.add_argument("query", nargs="?")
            p.add_argument("--all-docs", action="store_true")
        p.add_argument("--page")
        p.add_argument("--type")
        p.add_argument("--min-conf", type=float)
        p.add_argument("--limit", type=int, default=200)
        p.add_argument("--path")
        return p

    def resolve(self, name: str) -> str:
        """A document's id: the current one for "" and ".", an id as it is, else the latest of the one file name that equals or contains it."""
        if name in ("", "."):
            if self.current is None:
                raise CommandError("no document selected")
            return self.current
        known = self.documents
        exact = known.filter(known.document_id == name).limit(1).count() if re.match(ID, name) else 0
        if exact:
            return name
        low = F.lower("filename")
        wanted = name.lower()
        # One group over the matches: exact names win over parts.
        hits = known.filter(F.contains(low, F.lit(wanted))).groupBy((low == wanted).alias("exact"), "filename").agg(F.max_by("document_id", "ts").alias("id"))
        rows = hits.orderBy(F.desc("exact"), "filename").limit(SHOWN + 1).collect()
        best = [r for r in rows if r["exact"]] or rows
        if not best:
            raise CommandError(f"{name!r} is not in the library")
        if len({r["filename"] for r in best}) > 1:
            raise CommandError(f"{name!r} matches several documents: " + ", ".join(r["filename"] for r in best[:SHOWN]))
        return best[0]["id"]

    def _mine(self, rows: DataFrame, args: argparse.Namespace) -> DataFrame:
        self.current = self.resolve(args.file)
        return rows.filter(F.col(self.KEY) == self.current)

    def _selected(self, args: argparse.Namespace, types: tuple[str, ...] = ()) -> DataFrame:
        wanted = (args.type,) if args.type else types
        return B.selected(self._mine(self.blocks, args), wanted, args.page, args.min_conf)

    def _docs(self, args) -> DataFrame:
        return self.documents.orderBy(F.desc("ts"), self.KEY).limit(args.limit)

    def _use(self, args) -> DataFrame:
        return self._mine(self.documents, args)

    _status = _use

    def _of(self, kind: str) -> Callable[[argparse.Namespace], DataFrame]:
        return lambda args: self._selected(args, (kind,)).orderBy("order_no").limit(args.limit)

    def _text(self, args) -> DataFrame:
        return self._selected(args, B.TEXT_TYPES).orderBy("order_no").limit(args.limit)

    def _tables(self, args) -> DataFrame:
        blocks = self._selected(args, ("table",))
        grids = O.grids(self.cells.join(blocks.select(self.KEY, "id"), [self.KEY, "id"]), self.KEY).withColumnRenamed("text", "grid")
        return blocks.select(self.KEY, "id", "order_no", "page", "confidence").join(grids, [self.KEY, "id"], "left").orderBy("order_no").limit(args.limit)

    def _search(self, args) -> DataFrame:
        if args.all_docs:
            phrase, blocks = " ".join(w for w in (args.file, args.query) if w), B.selected(self.blocks, (args.type,) if args.type else (), args.page, args.min_conf)
        else:
            if args.query is None:
                args.file, args.query = "", args.file
            phrase, blocks = args.query, self._selected(args)
        cells = self.cells.join(blocks.select(self.KEY, "id"), [self.KEY, "id"], "left_semi")
        return B.search(O.search_units(blocks, cells, self.KEY), self.KEY, phrase, args.limit)

    def _summary(self, args) -> DataFrame:
        docs = self._mine(self.documents, args).select(self.KEY, "page_count", F.lit(None).cast("string").alias("source_kind"))
        return S.summaries(docs, self._mine(self.blocks, args), self.KEY)

    def _pages(self, args) -> DataFrame:
        kinds = ["heading", "paragraph", "list", "table", "figure", "chart", "equation"]
        last = F.greatest(F.coalesce("page_count", F.lit(0)), F.lit(0))
        pages = self._mine(self.documents, args).select(F.explode(F.when(last > 0, F.sequence(F.lit(1), last))).alias("page"))
        blocks = self._mine(self.blocks, args)
        pages = pages.unionByName(blocks.select(F.col("page").cast("int").alias("page"))).distinct()
        return R.child_counts(pages, blocks, ["page"], "type", {f"n_{k}": k for k in kinds}, "blocks").orderBy("page")

    def _markdown(self, args) -> DataFrame:
        from paperloom.operators.markup import markdown

        return markdown(self._selected(args), self.KEY)

    def _json(self, args) -> DataFrame:
        out = O.json_documents(self._mine(self.documents, args), {"blocks": (self._mine(self.blocks, args), ["order_no"]), "cells": (self._mine(self.cells, args), ["id", "row", "col"])}, self.KEY)
        if not args.path:
            return out
        return out.select(self.KEY, R.json_value(F.col("json"), args.path).alias("value"))

    def _export(self, args) -> DataFrame:
        if args.format in ("json", "md"):
            return self._json(args) if args.format == "json" else self._markdown(args)
        blocks, cells = self._selected(args), self._mine(self.cells, args)
        if args.format == "txt":
            return O.text_export(blocks, cells, self.KEY)
        return O.block_csv(blocks, cells, self.KEY).orderBy("order_no")
