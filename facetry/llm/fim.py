"""Fill-in-middle transformation: texts are cut in three at unit boundaries and put together anew around sentinels.

An Arrow-batched pandas UDF does the work.  `finditer` walks the units of a text once and their end offsets go to a
compact array of four bytes a unit; two lookups in it cut the text, however long it is.  Seeds come from the document's
id alone, so a row's result depends neither on its partition nor on other rows, and a recomputed task gives it again."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a code point.
CODE_POINTS = r"(?s)."
_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def seeds(doc_id: object, salt: str = "1") -> tuple[int, ...]:
    """Four 32-bit numbers from the SHA-256 of `<salt>:<id>`; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit of a text ends."""
    return array("I", (m.end() for m in unit.finditer(text)))


def cut(text: str, at: array, first: int, second: int) -> tuple[str, str, str]:
    """(prefix, middle, suffix): the prefix has `first` units, prefix and middle have `second`."""
    a, b = (at[k - 1] if k else 0 for k in (first, second))
    return text[:a], text[a:b], text[b:]


def arranged(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of.  Texts that hold a sentinel are left plain, so each stands once in an output."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX) if form == "psm" else reversed(head.removeprefix(SUFFIX).split(PREFIX))
    return f"{prefix}{middle}{suffix}"


def transformed(text: str, doc_id: object, unit: regex.Pattern, plain_percent: int, spm_percent: int, salt: str) -> tuple:
    """One row of the result (see fill_in_middle)."""
    at = ends(text, unit)
    n = len(at)
    h1, h2, h3, h4 = seeds(doc_id, salt)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_percent:
        form, sizes, output = "plain", (None, None), text
    else:
        form = "spm" if h4 % 100 < spm_percent else "psm"
        prefix, middle, suffix = cut(text, at, *sorted((h1 % (n + 1), h2 % (n + 1))))
        sizes, output = (len(prefix), len(middle)), arranged(form, prefix, middle, suffix)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (output, restored(output, form)))
    return n, form, *sizes, output, *digests


def fim(text: Column, doc_id: Column, unit: str = CODE_POINTS, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1") -> Column:
    """The transformation as a struct column of n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    @F.pandas_udf(_FIELDS)
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = [transformed(t or "", i, pattern, plain_percent, spm_percent, salt) for t, i in zip(texts, ids)]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in names if c in ("n", "prefix_chars", "middle_chars")})

    return run(text, doc_id.cast("string"))


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINTS, plain_percent: int = 10, spm_percent: int = 20, salt: str = "1", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256), one row per row of `docs`;
    columns in `carry` come along, others are ignored.

    A text is cut at two of its unit boundaries, drawn with the id; `unit` is a pattern of the regex library (what lies
    between matches goes with the unit after it, what follows the last with the suffix), n counts units, prefix_chars and
    middle_chars code points.  form is plain (the text as it is) for empty texts, texts that hold a sentinel and
    `plain_percent` of the ids; spm (suffix first) for `spm_percent` of the others; else psm.  restored_sha256 is the
    digest of the text rebuilt from the output.

    Null texts count as empty and give an empty output; a null id counts as an empty one; ids may be of any type that has
    a decimal or text form.  Repeated rows have equal results, an empty table gives no rows.  A text of any length is one
    value, with four bytes a unit beside it."""
    own = docs.select(F.col(id_col).alias("doc_id"), fim(F.col(text_col), F.col(id_col), unit, plain_percent, spm_percent, salt).alias("__fim"), *(F.col(c) for c in carry))
    return own.select("doc_id", *(F.col(f"__fim.{f.split()[0]}").alias(f.split()[0]) for f in _FIELDS.split(", ")), *carry)
