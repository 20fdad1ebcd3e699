"""Column functions over file texts: lines, escaping, hashes, word splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never keywords.
STOP = """the and for with from that this these those not are was were has have had but can will would should could into onto over under than then else when what which who why how all any each every some such own same other only also just very too more most less least out off its our your their there here where
self cls this that args kwargs arg argv param params def func fn var let const return returns true false none null nil undefined new get set put has len str int bool float double char byte void obj val vals tmp res err ret ptr ref refs num idx cnt buf src dst msg ctx cfg opts opt env impl util utils misc foo bar baz qux test tests spec mock todo fixme xxx main init assert equal expect should describe require testing value data index add remove type default create dict list key code next end name item log join console length format result output input check call run make update count first last size string number object array function method module export import""".split()


def count_lines(text: Column) -> Column:
    """A trailing break counts as one more line; null texts have one empty line."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_at(text: Column, number: int) -> Column:
    """The line of that number from 0, without a trailing carriage return; empty when out of range."""
    return F.regexp_replace(F.coalesce(F.get(F.split(text, "\n"), number), F.lit("")), "\r$", "")


def line_of_offset(text: Column, offset: Column) -> Column:
    """The number, from 0, of the line that holds the character at offset (from 1)."""
    return count_lines(F.substr(text, F.lit(1), offset - 1)) - 1


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def git_sha(text: Column) -> Column:
    """The blob hash of a text's UTF-8 bytes."""
    body = F.encode(text, "utf-8")
    head = F.concat(F.lit("blob "), F.octet_length(body).cast("string"), F.char(F.lit(0)))
    return F.sha1(F.concat(F.encode(head, "utf-8"), body))


def is_binary(text: Column) -> Column:
    """A NUL stands in the first 4000 characters."""
    return F.instr(F.substr(text, F.lit(1), F.lit(4000)), F.char(F.lit(0))) > 0


class Words(dict):
    """The words of a run of letters (bytes), which camel case parts: lower-cased, without plural endings, of three letters and more, and no stop words; or only
    the wanted ones. Runs that are known are kept, up to a bound."""

    PARTS, ALPHABET, MOST, LONG = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), bytes(c if chr(c).isascii() and chr(c).isalpha() else 32 for c in range(256)), 200_000, 64

    def __init__(self, wanted: list[str] | None = None):
        super().__init__()
        self.wanted, self.stop = None if wanted is None else frozenset(wanted), frozenset(STOP)

    def __missing__(self, run: bytes) -> tuple[str, ...]:
        stems = (stem(w.lower()) for w in ((run.decode(),) if run[1:].islower() else self.PARTS.findall(run.decode())))
        out = tuple(w for w in stems if len(w) >= 3 and w not in self.stop and (self.wanted is None or w in self.wanted))
        if len(run) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[run] = out
        return out

    def words(self, text: bytes) -> Iterator[str]:
        return chain.from_iterable(map(self.__getitem__, text.translate(self.ALPHABET).split()))


def stem(word: str) -> str:
    """Without the plural ending of words of five letters and more."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith(("ss", "us", "is", "os")) else word


def subsequence(query: str, text: Column) -> Column:
    """All characters of query stand in text in this order."""
    return text.rlike("(?s)" + ".*".join(re.escape(c) for c in query))
