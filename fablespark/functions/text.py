"""Column builders over text: splitting, cleaning, measuring and classifying, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# French question words, clause markers and emphasis words.
QUESTION_WORDS = ("qui", "que", "quoi", "où", "quand", "comment", "pourquoi", "quel", "quelle", "quels", "quelles", "lequel", "laquelle", "combien", "duquel", "auquel")
CONTINUING_WORDS = ("et", "ou", "mais", "car", "donc", "puis", "alors")
SUBORDINATE_WORDS = ("qui", "que", "dont", "où", "lequel", "laquelle", "lesquels", "lesquelles", "quand", "lorsque", "puisque", "comme", "si", "quoique")
SUBORDINATE_PHRASES = ("pendant que", "tandis que", "alors que", "parce que", "bien que", "afin que", "pour que", "avant que", "après que", "depuis que", "à condition que", "pourvu que", "sans que", "de sorte que")
EMPHASIS_WORDS = (
    "jamais", "toujours", "absolument", "vraiment", "totalement", "complètement", "parfaitement", "exactement", "certainement",
    "soudain", "soudainement", "brusquement", "subitement", "enfin", "finalement", "désormais",
    "mais", "cependant", "pourtant", "néanmoins", "toutefois", "or", "donc", "ainsi", "alors",
    "terrible", "incroyable", "extraordinaire", "magnifique", "horrible", "merveilleux", "épouvantable",
    "rien", "personne", "aucun", "aucune", "nul", "nulle", "même", "seul", "unique", "premier", "dernier",
)
CLAUSE_SPEEDS = {"main": 1.0, "subordinate": 1.05, "parenthetical": 1.08, "quote": 0.95, "emphasis": 0.97}
COMMA, PERIOD, PARAGRAPH = 0.3, 0.6, 1.0
PAUSES = {",": COMMA, ";": COMMA * 1.2, ":": COMMA * 1.1, ".": PERIOD, "!": PERIOD * 1.1, "?": PERIOD * 1.1, "...": PERIOD * 1.5, "…": PERIOD * 1.5, "\n\n": PARAGRAPH}
WORDS_PER_MINUTE = 150
CHARS_PER_SECOND = 15
CONTOURS = {
    "declarative": ((0.0, 0.0, 0.0, -1.0, -2.5), (0.15, 0.20, 0.30, 0.20, 0.15)),
    "question_yn": ((0.0, 0.0, 0.5, 2.0, 4.0), (0.20, 0.20, 0.25, 0.20, 0.15)),
    "question_wh": ((2.0, 1.0, 0.0, -0.5, -1.5), (0.15, 0.20, 0.30, 0.20, 0.15)),
    "exclamation": ((1.0, 2.5, 1.0, -1.0, -2.0), (0.10, 0.20, 0.30, 0.25, 0.15)),
    "continuation": ((0.0, 0.0, 0.0, 0.5, 1.0), (0.20, 0.20, 0.30, 0.15, 0.15)),
    "suspense": ((0.0, -0.5, -1.0, -1.5, -2.0), (0.15, 0.20, 0.30, 0.20, 0.15)),
    "neutral": ((0.0, 0.0, 0.0, 0.0, 0.0), (0.20, 0.20, 0.20, 0.20, 0.20)),
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: All Unicode white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(col(text), F.lit(SPACES))


def collapse(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def sentences(text: Column | str) -> Column:
    """Parts after `.`, `!` or `?` and white space; blank parts dropped."""
    # A part of a stripped text begins with what is no white space, so that a blank one is empty.
    return F.array_remove(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), "")


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), strip), lambda p: p != "")


def clauses(text: Column | str) -> Column:
    """Runs up to and with `.`, `!`, `?` or `;`, stripped; a last run without one as well."""
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(r"[^.!?;]+[.!?;]*"), F.lit(0)), strip), lambda c: c != "")


def words(text: Column | str) -> Column:
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(col(text), F.lit(r"(?U)\S+"), F.lit(0)))


def minutes(text: Column | str) -> Column:
    return word_count(text) / WORDS_PER_MINUTE


def conversion_minutes(text: Column | str, careful: bool = False) -> Column:
    return F.length(col(text)) / 1000 * 0.2 * (1.3 if careful else 1.0)


def truncate(text: Column | str, n: int) -> Column:
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def either(words: set[str]) -> str:
    """A pattern for the longest of these words at a place, which looks at each letter once."""
    rest: dict[str, set[str]] = {}
    for w in words - {""}:
        rest.setdefault(w[0], set()).add(w[1:])
    if not rest:
        return ""
    body = "|".join(re.escape(c) + either(r) for c, r in sorted(rest.items()))
    return f"(?:{body})?" if "" in words else body if len(rest) == 1 else f"(?:{body})"


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chain(text: Column | str, steps: tuple[tuple[str, str], ...]) -> Column:
    """Regular-expression replacements one after another."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, col(text))


# Order matters, each step sees what the one before left.
MARKDOWN = (
    (r"(?s)```.*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(?m)^[ \t]*\d+\.[ \t]+", ""),
    (r"(?m)^>[ \t]?", ""),
    (r"(?m)^(?:-{3,}|\*{3,}|_{3,})$", ""),
    (r"(?m)^#{1,6}[ \t]+", ""),
    (r"\n{3,}", "\n\n"),
)
SPEECH = (
    (r"(?U)\s+", " "),
    (r"[—–]", "-"),
    (r"[*_#`~]", ""),
    (r"\.{4,}", "..."),
    (r"!{2,}", "!"),
    (r"\?{2,}", "?"),
)


def plain_markdown(text: Column | str) -> Column:
    return strip(chain(text, MARKDOWN))


def clean_for_speech(text: Column | str) -> Column:
    return strip(chain(text, SPEECH))


def markdown_to_html(text: Column | str) -> Column:
    return chain(
        text,
        (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>")),
    )


def html_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(col(html), r"(?i)<h[12][^>]*>([^<]+)</h[12]>", 1))


def html_text(html: Column | str) -> Column:
    """Text of a page: scripts, styles and page furniture dropped, tags as spaces."""
    out = F.regexp_replace(col(html), r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1\s*>", " ")
    return collapse(F.regexp_replace(out, r"<[^>]+>", " "))


def without_tags(html: Column | str) -> Column:
    return collapse(F.regexp_replace(col(html), "<[^>]+>", " "))


def is_dialogue(text: Column | str) -> Column:
    return col(text).rlike(r"[«»\"]|^\s*[-–—]")


def is_parenthetical(text: Column | str) -> Column:
    t = strip(text)
    return (t.startswith("(") & t.endswith(")")) | (t.startswith("—") & t.endswith("—")) | (t.startswith("–") & t.endswith("–"))


def contour(text: Column | str, stripped: bool = False) -> Column:
    """Intonation from the last mark of a sentence; its first word tells open questions. stripped: the text has no white space at its ends."""
    t = col(text) if stripped else strip(text)
    plain = words(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", ""))
    first = F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit(""))
    asked = first.isin(*QUESTION_WORDS) | ((F.size(plain) > 3) & (F.array_join(F.slice(plain, 1, 3), " ") == "est ce que") & F.try_element_at(plain, F.lit(4)).isin(*QUESTION_WORDS))
    goes_on = F.lower(t).rlike(rf"(?U)(?:\A|\s)(?:{'|'.join(CONTINUING_WORDS)})[.,;:]*+\z")
    return (
        F.when(t == "", "neutral")
        .when(t.endswith("?"), F.when(asked, "question_wh").otherwise("question_yn"))
        .when(t.endswith("!"), "exclamation")
        .when(t.endswith("...") | t.endswith("…"), "suspense")
        .when(t.endswith(",") | t.endswith(";") | goes_on, "continuation")
        .when(t.endswith(".") | t.rlike(r"[\p{L}\p{N}]$"), "declarative")
        .otherwise("neutral")
    )


def contour_knots(kind: Column | str, seconds: Column | float) -> Column:
    """struct(knot, start, end, pitch) of the five parts of an intonation laid over so many seconds."""
    parts = []
    for name, (pitches, weights) in CONTOURS.items():
        ends, total = [], 0.0
        for w in weights:
            ends.append((total, total + w))
            total += w
        made = [F.struct(F.lit(i).alias("knot"), (F.lit(a / total) * seconds).alias("start"), (F.lit(b / total) * seconds).alias("end"), F.lit(p).alias("pitch")) for i, ((a, b), p) in enumerate(zip(ends, pitches, strict=True))]
        parts.append((name, F.array(*made)))
    return reduce(lambda c, p: c.when(col(kind) == p[0], p[1]), parts, F.when(F.lit(False), parts[0][1]))


def clause_type(text: Column | str) -> Column:
    """By opening mark, brackets, first words and emphasis words; one compiled pattern for each test."""
    t = col(text)
    low = strip(F.lower(t))
    spaced = "|".join(p.replace(" ", r"\s+") for p in SUBORDINATE_PHRASES)
    subordinate = low.rlike(rf"(?U)^(?:[.,;:!?]*(?:{'|'.join(SUBORDINATE_WORDS)})[.,;:!?]*(?=\s|$)|(?:{spaced}))")
    emphatic = low.rlike(rf"(?U)\b(?:{'|'.join(EMPHASIS_WORDS)})\b")
    return (
        F.when(t.startswith('"') | t.startswith("«") | t.startswith("—"), "quote")
        .when(is_parenthetical(t), "parenthetical")
        .when(subordinate, "subordinate")
        .when(emphatic, "emphasis")
        .otherwise("main")
    )


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for item in table.items() for x in item])[key], F.lit(default))


def clause_speed(kind: Column) -> Column:
    return lookup(kind, CLAUSE_SPEEDS, 1.0)


def closing_mark(text: Column | str) -> Column:
    """The mark that ends a text: an ellipsis as a whole, else its last character."""
    t = strip(text)
    return F.when(t.endswith("..."), "...").otherwise(F.substring(t, -1, 1))


def pause_after(text: Column | str, kind: Column | None = None) -> Column:
    """Seconds of pause for the closing mark, shorter after faster clauses (kind: the clause's type, if known)."""
    return lookup(closing_mark(text), PAUSES, 0.2) / clause_speed(clause_type(text) if kind is None else kind)


def cache_key(text: Column | str, voice: Column | str, speed: Column | str) -> Column:
    return F.md5(F.concat_ws("|", col(text), col(voice), F.format_string("%.2f", col(speed))))


def roman_value(numeral: Column | str) -> Column:
    """Value of a Roman numeral, a smaller letter before a larger one subtracting."""
    value = F.transform(F.split(F.reverse(F.upper(col(numeral))), ""), lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])[c], F.lit(0)))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("before"))
    return F.aggregate(value, start, lambda a, v: F.struct(F.when(v < a["before"], a["sum"] - v).otherwise(a["sum"] + v).alias("sum"), v.alias("before")), lambda a: a["sum"])


def pack(parts: Column, limit: int, joiner: str = " ") -> Column:
    """Greedy chunks: parts in order, joined while the chunk stays within `limit` characters."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["open"]) + F.length(p) + len(joiner) <= limit
        return (
            F.when(a["open"] == "", F.struct(p.alias("open"), a["done"].alias("done")))
            .when(fits, F.struct(F.concat(a["open"], F.lit(joiner), p).alias("open"), a["done"].alias("done")))
            .otherwise(F.struct(p.alias("open"), F.array_append(a["done"], a["open"]).alias("done")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))
