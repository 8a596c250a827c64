"""Body text of pages, in Arrow batches; parsing has no built-in function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "title"}
_BREAK = {"p", "div", "li", "h1", "h2", "h3", "h4", "article", "section", "tr", "blockquote"}


class _Body(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _SKIP
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in _SKIP))
        if tag in _BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def main_text(page: str | None) -> str | None:
    """Text outside navigation, forms and scripts, a line per block; None if there is none."""
    if not page:
        return None
    parser = _Body()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x) or None


def body_text(page: Column | str) -> Column:
    return F.pandas_udf(_bodies, "string")(page)


def _bodies(page: pd.Series) -> pd.Series:
    return page.map(main_text)
