"""Text of HTML pages: a parser in Arrow batches, since script and style bodies are no markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(page: str | None) -> str | None:
    """Text nodes outside script and style, stripped, one a line; null for null."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts)


def with_html_text(df: DataFrame, html: str, out: str = "text") -> DataFrame:
    """``df`` with the page in ``html`` replaced by its text in ``out``."""
    names = [n for n in df.columns if n != html]
    shape = ", ".join([*(f"`{n}` {t}" for n, t in df.drop(html).dtypes), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([html_text(x) for x in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], [*names, out])

    return df.mapInArrow(run, shape)
