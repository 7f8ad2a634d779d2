"""Normalisation, tokens and hashes as column expressions.

Patterns carry (?d), so that only \\n ends a line, and white space is Unicode's as well as \\x1c-\\x1f.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the separators that the Unicode class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The ASCII punctuation that normalisation deletes. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(c: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def normalize(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Words and line ends; joined they give the text's words back. The default tokenizer, which can be replaced."""
    return F.regexp_extract_all(c, F.lit(r"\S+|\n"), F.lit(0))


def memory_hash(docs: Column) -> Column:
    """SHA-1 of the documents, each followed by a NUL."""
    return F.sha1(F.when(F.size(docs) > 0, F.concat(F.array_join(docs, "\0"), F.lit("\0"))).otherwise(F.lit("")))


def regroup_key(docs: Column) -> Column:
    """MD5 of the documents on end."""
    return F.md5(F.array_join(docs, ""))


def request_seed(base: Column, request_id: Column) -> Column:
    """31 bits of the SHA-1 of base|id."""
    digest = F.sha1(F.concat(base.cast("string"), F.lit("|"), request_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def order_key(seed: object, salt: object, key: Column) -> Column:
    """What rows are ordered by where the order is to be random but the same everywhere."""
    as_text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.md5(F.concat(as_text(seed), F.lit("|"), as_text(salt), F.lit("|"), as_text(key)))


def draw(seed: object, salt: object, key: Column) -> Column:
    """A number in [0, 1), by the same hash."""
    return F.conv(F.substring(order_key(seed, salt, key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3).cast("int"))


def uri_name(c: Column) -> Column:
    """A title from a URI's last segment."""
    last = F.element_at(F.split(c, "/"), -1)
    return collapse(F.regexp_replace(F.regexp_replace(last, "[_>-]", " "), r"\([^()]*\)", ""))
