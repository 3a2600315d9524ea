"""Search as a table function, for use from SQL: ``SELECT * FROM documents, LATERAL search_lines(text, 'pattern')``."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from .pattern import compile_pattern

NAME = "search_lines"


class SearchLines:
    """(line_number, start, end, line) of each match in a text, start and end in bytes of its line.

    The pattern and the options (case, and whether it is fixed) are constants, and are checked when the query is planned.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, case: AnalyzeArgument | None = None, fixed: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("pattern", pattern), ("case", case), ("fixed", fixed)):
            if given is not None and (not given.isConstantExpression or given.value is None):
                raise ValueError(f"{name} has to be a constant")
        compile_pattern(pattern.value, case=case.value if case else "sensitive", fixed=bool(fixed and fixed.value))
        return AnalyzeResult(StructType().add("line_number", "long").add("start", "long").add("end", "long").add("line", "string"))

    def __init__(self) -> None:
        self.found = None

    def eval(self, text: str | None, pattern: str, case: str = "sensitive", fixed: bool = False) -> Iterator[tuple[int, int, int, str]]:
        if self.found is None:
            self.found = regex.compile(compile_pattern(pattern, case=case, fixed=fixed).python())
        if not text:
            return
        for number, line in enumerate(text.removesuffix("\n").split("\n"), 1):
            last = None
            for m in self.found.finditer(line):
                if m.end() > m.start() or m.start() != last:  # no empty match that touches the one before
                    last = m.end()
                    start = len(line[: m.start()].encode())
                    yield number, start, start + len(m[0].encode()), line


def register(spark: SparkSession, name: str = NAME) -> None:
    spark.udtf.register(name, udtf(SearchLines))
