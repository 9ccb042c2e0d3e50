"""A short extract that stands for a text: its opening, dialogue, a moving passage, then what follows, within a budget.

All of it is array functions over a text's own paragraphs, so no row meets another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .attribution import emotional_score

TARGET = 450  # characters, about 30 seconds
ENOUGH = 0.7
DIALOGUE = (r'(?d)[«"].*?[»"]', r"(?dU)[-–—]\s*.+")


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _best(items: Column, score) -> Column:
    """The first of the items with the highest score over 0."""
    ranked = F.transform(items, lambda p, i: F.struct(score(p).alias("score"), (-i).alias("rank"), p.alias("p")))
    return T.let(F.array_max(ranked), lambda b: F.when(b["score"] > 0, b["p"]))


def truncated(text: Column, size: int) -> Column:
    """At most `size` characters, up to the last end of a sentence if that lies beyond half of them."""
    cut = F.substring(text, 1, size)
    ends = [F.when(F.locate(m, cut) > 0, F.length(cut) - F.locate(m, F.reverse(cut)) + 1).otherwise(0) for m in ".!?"]
    last = F.greatest(*ends)
    return F.when(F.length(text) <= size, text).when(last - 1 > size * 0.5, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)


def selected(paragraphs: Column, lang: str = "fr", target: int = TARGET) -> Column:
    """The paragraphs of a preview, in the order in which they are chosen; null without paragraphs.

    The first always; then the first with dialogue and the most moving one, each if it leaves room and is not there yet;
    then, while under ENOUGH of the target, the others in order, up to the first that does not fit.
    """
    rest = F.slice(paragraphs, F.lit(2), F.greatest(F.size(paragraphs) - 1, F.lit(0)))
    size = lambda items: F.aggregate(items, F.lit(0), lambda a, p: a + F.length(p))
    add = lambda s, p: F.when(p.isNotNull() & (size(s) + F.length(p) < target) & ~F.array_contains(s, p), F.array_append(s, p)).otherwise(s)
    spoken = lambda s: T.let(_first(rest, lambda p: reduce(lambda a, b: a | b, (p.rlike(d) for d in DIALOGUE))), lambda p: F.when(p.isNotNull() & (size(s) + F.length(p) < target), F.array_append(s, p)).otherwise(s))
    moving = lambda s: T.let(_best(rest, lambda p: emotional_score(p, lang)), lambda p: add(s, p))

    def filled(s: Column) -> Column:
        """With the fillers whose running size stays under the target: sizes only grow, so the first that does not fit ends it."""
        state = lambda total, n: F.struct(total.alias("total"), n.alias("n"))
        others = F.array_except(rest, s)
        taken = F.aggregate(others, state(size(s), F.lit(0)), lambda a, p: state(a["total"] + F.length(p), a["n"] + (a["total"] + F.length(p) < target).cast("int")), lambda a: a["n"])
        return F.when(size(s) < target * ENOUGH, F.concat(s, F.slice(others, F.lit(1), taken))).otherwise(s)

    chosen = T.let(T.let(T.let(F.slice(paragraphs, 1, 1), spoken), moving), filled)
    return F.when(F.size(paragraphs) > 0, chosen)


def preview(text: Column | str, lang: str = "fr", target: int = TARGET) -> Column:
    """The preview of a text: its selected paragraphs, cut to the target; the bare start of a text without any."""
    t = T.col(text)
    whole = T.let(T.paragraphs(t), lambda p: F.array_join(selected(p, lang, target), "\n\n"))
    return F.coalesce(T.let(whole, lambda w: truncated(w, target)), F.substring(t, 1, target))
