"""Text expressions. All stay JVM-side."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as white space.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The same without the plain blank, which is looked for in a cheaper way.
OTHER_SPACE = SPACE.replace("\\x1c- ", "\\x1c-\\x1f")

# Fixed value: what counts as a well-formed e-mail address.
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"

_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def trim_spaces(text: Column) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` only removes U+0020)."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def squeeze_spaces(text: Column) -> Column:
    """Collapse every run of white space to one blank and strip the ends.

    Only texts with a double blank or another kind of white space need the regular expression.
    """
    uneven = F.contains(text, F.lit("  ")) | text.rlike(OTHER_SPACE)
    return F.trim(F.when(uneven, F.regexp_replace(text, SPACE + "+", " ")).otherwise(text))


def fold(text: Column) -> Column:
    """The spelling under which two values are considered the same category."""
    return F.lower(trim_spaces(text))


def has_space_defect(text: Column) -> Column:
    inside = F.contains(text, F.lit("  ")) | (text.rlike(OTHER_SPACE) & text.rlike(SPACE + "{2,}"))
    return (text != trim_spaces(text)) | inside


def title_case(text: Column) -> Column:
    """Capitalise after every non-letter: ``wi-fi 3rd`` becomes ``Wi-Fi 3Rd``.

    ``initcap`` only restarts after a blank, which is enough for plain ASCII words. Any other text
    is cut into runs of letters and runs of everything else; the other runs are unchanged by
    upper/lower.
    """
    # most texts are settled by the first, much cheaper test
    plain = ~text.rlike(r"[^A-Za-z ]") | ~text.rlike(r"[^A-Za-z ][A-Za-z]|[^\x00-\x7f]")
    runs = F.regexp_extract_all(text, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    capitalised = F.transform(
        runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2))))
    )
    return F.when(plain, F.initcap(text)).otherwise(F.array_join(capitalised, ""))


def recase(text: Column, strategy: str) -> Column:
    if strategy == "title":
        return title_case(text)
    if strategy == "lower":
        return F.lower(text)
    if strategy == "upper":
        return F.upper(text)
    return text


def is_email(text: Column) -> Column:
    # the cheap test spares most other texts the regular expression
    return F.contains(text, F.lit("@")) & trim_spaces(text).rlike(EMAIL_PATTERN)


def translate_terms(text: Column, terms: dict[str, str]) -> Column:
    """Replace known spellings by their canonical term; anything else stays as it is.

    ``terms`` is a dictionary of the program, not of the data, so it becomes a map literal.
    """
    pairs = [F.lit(part) for item in terms.items() for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), fold(text)), text)
