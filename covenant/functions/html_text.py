"""The text of HTML without its scripts and styles, over Arrow batches.

Comments, whole script and style elements, declarations and tags are cut out. What stands between, with character
references decoded and its ends trimmed, is joined by spaces.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.functions.markup import markup

RAW = frozenset({"script", "style"})


def text_of(page: str | None) -> str | None:
    if page is None:
        return None
    out, at = [], 0
    for m in markup(page, RAW):
        out.append(page[at : m.start])
        at = m.end
    return " ".join(filter(None, (html.unescape(x).strip() for x in [*out, page[at:]])))


@F.arrow_udf(T.StringType())
def _texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([text_of(p) for p in batch.to_pylist()], pa.string())


def html_text(page: Column | str) -> Column:
    return _texts(page)
