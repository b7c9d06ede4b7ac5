"""Text expressions. All run inside the JVM; none needs a Python worker."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark import vocab
from matchspark.functions.once import let

# Characters are listed one by one: the JVM tests such a class with one bit-set
# lookup, a class of ranges with a chain of comparisons (three times slower here).
_LETTERS = string.ascii_letters
_ALNUM = _LETTERS + string.digits
_BASE64 = f"[{_ALNUM}+/=]"
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))

# What counts as noise (base64 images and PDFs, long unbroken runs,
# symbol runs, runs of plain words). Quantifiers are possessive, because the JVM
# recurses on greedy groups and overflows its stack on long texts; the lookbehinds
# only skip starts inside a run that already failed from its first character.
NOISE_PATTERN = (
    f"/9j/{_BASE64}{{30,}}+"
    f"|iVBORw0KGgo{_BASE64}{{30,}}+"
    f"|JVBERi0x{_BASE64}{{30,}}+"
    f"|(?<![{_ALNUM}]){_BASE64}{{80,}}+"
    f"|[^{_ALNUM} ]{{30,}}+"
)
PROSE_RUN = f"|(?<![{_LETTERS}])(?:[{_LETTERS}]{{3,}}+ ){{15,}}+"

# Characters kept by the older vacancy cleaning.
DROPPED_CHARS = f"""[^{_ALNUM}{_LATIN} .,;:!?()_'"-]"""

# Unicode blanks, as a Python strip() or split() sees them.
_NARROW_BLANKS = r" \t\n\r\f\x0B\x1C\x1D\x1E\x1F\x{85}\x{A0}"
_WIDE_BLANKS = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK_CLASS = f"[{_NARROW_BLANKS}{_WIDE_BLANKS}]"
# The same class as a bit set, with one range test before the rarer wide blanks.
BLANK = f"(?:[{_NARROW_BLANKS}]|(?=[\\x{{1680}}-\\x{{3000}}])[{_WIDE_BLANKS}])"

# Named HTML entities. The ampersand is decoded last.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·",
    "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "yen": "¥",
    "cent": "¢", "sect": "§", "deg": "°", "plusmn": "±", "laquo": "«", "raquo": "»",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "times": "×", "agrave": "à",
    "aacute": "á", "egrave": "è", "eacute": "é", "igrave": "ì", "iacute": "í",
    "ograve": "ò", "oacute": "ó", "ugrave": "ù", "uacute": "ú", "ntilde": "ñ",
    "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß",
    "Agrave": "À", "Egrave": "È", "Eacute": "É", "Igrave": "Ì", "Ograve": "Ò",
    "Ugrave": "Ù", "amp": "&",
}


def not_blank(c: Column) -> Column:
    """True or false, never null."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}++|{BLANK}++$", "")


def place_name(c: Column) -> Column:
    """A place as it is compared everywhere: outer blanks gone, lower case, never null."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def remove_noise(c: Column, prose_runs: bool = True) -> Column:
    return F.regexp_replace(c, NOISE_PATTERN + (PROSE_RUN if prose_runs else ""), "")


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces and tabs become one space, ends are stripped; null becomes ''."""
    return F.coalesce(strip(F.regexp_replace(c, r"[ \t]++", " ")), F.lit(""))


def _numeric_entities(c: Column) -> Column:
    def piece(p: Column) -> Column:
        hexadecimal = F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        decimal = F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(
            decimal != "", decimal).try_cast("long")
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(
            F.coalesce(usable, F.lit(False)),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        ).otherwise(p)

    parts = F.split(c, r"(?=&#[0-9xX])|(?<=&#[0-9a-fA-FxX]{1,8};)")
    return F.when(F.contains(c, F.lit("&#")), F.concat_ws("", F.transform(parts, piece))).otherwise(c)


def _named_entities(c: Column) -> Column:
    """Only the names that occur are replaced; the ampersand comes last."""
    known = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (f"&{k};", v)])
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("&[A-Za-z]++;"), F.lit(0)))
    named = F.aggregate(
        F.filter(found, lambda e: e != "&amp;"), c,
        lambda acc, e: F.replace(acc, e, F.coalesce(F.try_element_at(known, e), e)))
    return F.replace(named, F.lit("&amp;"), F.lit("&"))


def decode_entities(c: Column) -> Column:
    return let(c, lambda x: F.when(
        F.contains(x, F.lit("&")), let(_numeric_entities(x), _named_entities)).otherwise(x))


def _remove_tags(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?is)<(script|style|template)\b[^>]*+>.*?</\1\s*+>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<[!?][^>]*+>", "")
    return F.regexp_replace(text, r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "")


def strip_html(c: Column) -> Column:
    """Visible text of an HTML fragment; null becomes ''."""
    visible = let(c, lambda x: F.when(F.contains(x, F.lit("<")), _remove_tags(x)).otherwise(x))
    return F.coalesce(decode_entities(visible), F.lit(""))


def cap_length(c: Column, cap: int) -> Column:
    """Texts over the cap become '' (not null)."""
    return let(c, lambda x: F.when(F.length(x) > cap, F.lit("")).otherwise(x))


def keep_latin(c: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(c), f"{BLANK}++", " ")
    return F.coalesce(F.regexp_replace(squeezed, DROPPED_CHARS, ""), F.lit(""))


def usable_text(c: Column) -> Column:
    """More than five characters and no 'null' inside."""
    return F.coalesce((F.length(F.trim(c)) > 5) & ~c.contains("null"), F.lit(False))


def valid_text(c: Column) -> Column:
    """Null for blanks and for the words a model writes when it knows nothing."""
    return F.when(not_blank(c) & ~F.lower(F.trim(c)).isin(vocab.JUNK_WORDS), c)


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]++", "")


def split_members(c: Column, sep: str = ",") -> Column:
    """Comma list to trimmed members; blanks dropped, null stays null."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]++"), lambda x: x != "")
