"""The full caption cleaner: the plain steps with markup and entities removed between them."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions.text import clean_end, clean_start, clean_symbols, strip
from spindle.ship import bounded

# What common characters become when UTF-8 is read as Windows-1252.
_CODEC = "cp1252"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def visible(text: str | None) -> str | None:
    """Text without tags; contents of all elements stay."""
    if text is None or ("<" not in text and "&" not in text):
        return text
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.parts)


def mended(text: str | None) -> str | None:
    """Mis-decoded UTF-8 decoded again where that is clean, compatible forms composed, entities resolved twice."""
    if text is None:
        return None
    if any("Â" <= c <= "ô" for c in text):
        try:
            text = text.encode(_CODEC).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return html.unescape(html.unescape(unicodedata.normalize("NFC", text))).strip()


def _by_batch(f: Callable[[str | None], str | None]):
    """A pandas UDF of a text function; made where it is used, since workers import this module too."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def clean_once(c: Column) -> Column:
    return clean_end(strip(_by_batch(mended)(clean_symbols(_by_batch(visible)(clean_start(c))))))


def clean_caption(c: Column) -> Column:
    """The cleaner, applied twice."""
    bounded()
    return clean_once(clean_once(c))
