"""Numbers as words in French and English, from rules, as JVM-side expressions.

The words of 0 to 999 are built by rule when a plan is made and become one array literal; larger
numbers are put together from groups of three digits, so no row meets Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .text import col

# Number words and months.
UNITS = {
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split(),
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
}
TENS = {
    "fr": ["", "", "vingt", "trente", "quarante", "cinquante", "soixante", "soixante", "quatre-vingt", "quatre-vingt"],
    "en": ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"],
}
MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


def small(n: int, lang: str) -> str:
    """0 to 999 in words."""
    if n < 20:
        return UNITS[lang][n]
    hundreds, rest = divmod(n, 100)
    if hundreds:
        if lang == "en":
            return f"{UNITS['en'][hundreds]} hundred" + (f" {small(rest, lang)}" if rest else "")
        head = "cent" if hundreds == 1 else f"{UNITS['fr'][hundreds]} cent" + ("" if rest else "s")
        return head + (f" {small(rest, lang)}" if rest else "")
    ten, unit = divmod(n, 10)
    if lang == "en":
        return TENS["en"][ten] + (f"-{UNITS['en'][unit]}" if unit else "")
    if ten in (7, 9):
        unit += 10
    if n == 80:
        return "quatre-vingts"
    if not unit:
        return TENS["fr"][ten]
    return TENS["fr"][ten] + ("-et-" if unit == 1 and ten < 7 else "-") + UNITS["fr"][unit]


def in_words(number: Column | str, lang: str = "fr", zero: str | None = None) -> Column:
    """An integer of less than 10^18 in size, in words; null for null or a larger one."""
    # One literal, split when the plan is made, is a far smaller expression than a thousand.
    table = F.split(F.lit("\n".join(small(n, lang) for n in range(1000))), "\n")
    million, millions = ("million", "millions") if lang == "fr" else ("million", "million")
    billion, billions = ("milliard", "milliards") if lang == "fr" else ("billion", "billion")
    thousand = "mille" if lang == "fr" else "thousand"

    def under(group: Column, one: str, many: str) -> Column:
        """A group of three digits and its name, nothing for zero."""
        return F.when(group > 0, F.concat(F.get(table, group), F.when(group > 1, F.lit(f" {many}")).otherwise(f" {one}")))

    def below(size: Column) -> Column:
        """A number under 10^9."""
        g = [(F.floor(size / 1000**k) % 1000).cast("int") for k in range(3)]
        thousands = under(g[1], thousand, thousand)
        if lang == "fr":
            thousands = F.when(g[1] == 1, thousand).otherwise(thousands)
        return F.concat_ws(" ", under(g[2], million, millions), thousands, F.when(g[0] > 0, F.get(table, g[0])))

    def named(n: Column) -> Column:
        high, low = (F.abs(n) - F.abs(n) % 10**9) / 10**9, F.abs(n) % 10**9
        head = F.when(high > 0, F.concat(T.let(high.cast("long"), below), F.when(high > 1, f" {billions}").otherwise(f" {billion}")))
        sign = F.when(n < 0, "moins " if lang == "fr" else "minus ").otherwise("")
        rest = F.when(low > 0, T.let(low, below))
        return F.when(n == 0, UNITS[lang][0] if zero is None else zero).when((n > 0) & (n < 1000), F.get(table, n.cast("int"))).when(F.abs(n) < 10**18, F.concat(sign, F.concat_ws(" ", head, rest)))

    return T.let(col(number).cast("long"), named)


def date_in_words(date: Column | str) -> Column:
    """A date as it is read out in French; the first of a month is `premier`."""
    d = col(date)
    day = F.when(F.dayofmonth(d) == 1, F.lit("premier")).otherwise(in_words(F.dayofmonth(d)))
    return F.concat_ws(" ", day, F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), in_words(F.year(d)))


def money_in_words(amount: Column | str) -> Column:
    """Euros and cents in French."""
    cents = F.round(F.abs(col(amount)) * 100).cast("long")
    euros, rest = F.floor(cents / 100), cents % 100
    head = F.concat(in_words(euros), F.when(euros > 1, F.lit(" euros")).otherwise(" euro"))
    return F.when(rest == 0, head).otherwise(F.concat(head, F.lit(" et "), in_words(rest), F.when(rest > 1, F.lit(" centimes")).otherwise(" centime")))
