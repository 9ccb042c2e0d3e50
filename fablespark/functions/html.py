"""Pages as readable lines: what a reader sees, with a line for each block, all in JVM functions on the page's own row.

Comments, declarations, scripts and styles go first, whatever they hold. The page is then cut at the tags of elements that no
reader wants; how many of them are open is counted over these cuts, so they may nest. Of what lies outside, block tags end
lines, other tags vanish, character references become characters and runs of spaces and lines are closed up.

Tags without a partner: an element that is never closed lasts to the end of the page, a close without an opening does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

SKIPPED = ("nav", "header", "footer")
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
UNSEEN = rf"(?is)<!--.*?-->|<(script|style)\b{REST}.*?(?:</\1\b[^>]*>|\z)|<[!?][^>]*>"
# Named character references that pages commonly use.
NAMED = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("laquo", "«"), ("raquo", "»"),
    ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("hellip", "…"), ("euro", "€"),
    ("eacute", "é"), ("egrave", "è"), ("ecirc", "ê"), ("agrave", "à"), ("acirc", "â"), ("ccedil", "ç"), ("ocirc", "ô"), ("ugrave", "ù"), ("icirc", "î"), ("uuml", "ü"), ("ouml", "ö"), ("auml", "ä"), ("szlig", "ß"), ("ntilde", "ñ"),
)


def unescaped(text: Column | str) -> Column:
    """Character references as characters: the named ones of NAMED, numbers in either base, & last."""
    t = T.col(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    hexadecimal = lambda r: F.substring(r, 3, 1).isin("x", "X")
    code = lambda r: F.when(hexadecimal(r), F.conv(F.regexp_extract(r, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    # The four bytes of a code point in UTF-32.
    sign = lambda r: F.decode(F.unhex(F.lpad(F.hex(code(r)), 8, "0")), "UTF-32")
    usable = lambda r: ((code(r) > 0) & (code(r) < 0xD800)) | ((code(r) > 0xDFFF) & (code(r) < 0x110000))
    numbers = F.aggregate(F.filter(found, usable), t, lambda a, r: F.replace(a, r, sign(r)))
    out = F.when(F.size(found) > 0, numbers).otherwise(t)
    for name, char in NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(t, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(t)


def outside(html: Column, elements: tuple[str, ...]) -> Column:
    """What lies outside all of the elements, however they nest."""
    mark = rf"(?i)</?(?:{'|'.join(elements)})\b{REST}"
    parts, marks = F.split(html, mark, -1), F.regexp_extract_all(html, F.lit(mark), F.lit(0))
    state = lambda depth, kept: F.struct(depth.alias("depth"), kept.alias("kept"))

    def step(a: Column, z: Column) -> Column:
        depth = F.when(F.startswith(z["mark"], F.lit("</")), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"] + 1)
        return state(depth, F.when(depth == 0, F.array_append(a["kept"], z["part"])).otherwise(a["kept"]))

    pairs = F.zip_with(marks, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, p: F.struct(m.alias("mark"), p.alias("part")))
    kept = F.aggregate(pairs, state(F.lit(0), F.slice(parts, 1, 1)), step, lambda a: a["kept"])
    return F.when(F.size(marks) > 0, F.array_join(kept, "")).otherwise(html)


def page_lines(html: Column | str, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """The text of a page, a line for each block and an empty one above its headings."""
    seen = F.regexp_replace(T.col(html), UNSEEN, "")
    return T.let(seen, lambda s: _closed_up(_lined(outside(s, skipped))))


def _lined(html: Column) -> Column:
    steps = ((rf"(?i)<h[1-3]\b{REST}", "\n\n"), (rf"(?i)<(?:p|div|h[4-6]|br)\b{REST}|</(?:p|div|h[1-6])\b[^>]*>", "\n"), (rf"</?[a-zA-Z]{REST}|</[^a-zA-Z][^>]*>", ""))
    return unescaped(T.chain(html, steps))


def _closed_up(text: Column) -> Column:
    return T.strip(T.chain(text, ((r"\n{3,}", "\n\n"), (" +", " "))))


def page_markdown(html: Column | str) -> Column:
    """A page as Markdown: headings of level n with n + 1 signs (one is the book's title), paragraphs with an empty line after them."""
    out = F.regexp_replace(T.col(html), UNSEEN, "")
    for level in range(1, 5):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b{REST}(.*?)</h{level}\s*>", f"\n{'#' * (level + 1)} $1\n")
    steps = ((r"(?i)</p\s*>", "\n\n"), (rf"</?[a-zA-Z]{REST}|</[^a-zA-Z][^>]*>", ""))
    return F.regexp_replace(unescaped(T.chain(out, steps)), r"\n{3,}", "\n\n")
