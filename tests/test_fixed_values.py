"""A few fixed values pinned by hand: the SQL of many queries is made from the same tables, so it cannot tell a wrong one."""

from fablespark.functions import prosody as P
from fablespark.functions import text as T
from fablespark.operators import emotion, lexicon, markup, tags


def test_lexicons():
    assert lexicon.keywords("fr", "fear")[:3] == ("peur", "terreur", "effroi") and lexicon.keywords("fr", "suspense")[1] == "tout a coup"
    assert lexicon.keywords("en", "tenderness")[-1] == "cherish" and list(lexicon.LEXICON["en"]) == ["joy", "sadness", "anger", "fear", "surprise", "excitement", "tenderness", "suspense"]
    assert emotion.KEYWORDS["fear"] == ("peur", "terreur", "effraye", "anxieux", "trembler", "craindre") and len(lexicon.SOUNDS["fr"]) == 47


def test_tags_and_markup():
    known = {t[0]: t[1:] for t in tags.TAGS}
    assert known["excited"] == ("emotion", None, 1.15, 1.1, 0.3, 0.0, 0.0) and known["silence"][-1] == 1.5 and tags.ALIASES["mad"] == "angry"
    assert markup.EFFECTS["em"] == (0.92, 0.5, 1.1, 0.05) and markup.EFFECTS["whisper"][2] == 0.6 and markup.PAUSE == 0.15


def test_prosody():
    assert P.STYLE_PROFILES["dramatic"] == (0.92, 0.0, 1.05, 0.12, 1.0, 0.15, 1.3, 0.6, 1.2, 1.5, True) and P.STYLE_PROFILES["formal"][-1] is False
    assert P.EXAGGERATIONS["fear"] == (0.15, 0.25, 0.0) and P.BLENDS["anger"] == ("am_adam", 0.3) and P.MODIFIERS["suspense"] == (0.9, -0.03, 0.0)
    assert T.CLAUSE_SPEEDS["parenthetical"] == 1.08 and abs(T.PAUSES["..."] - 0.9) < 1e-12 and abs(sum(T.CONTOURS["question_yn"][1]) - 1) < 1e-9
    assert emotion.TRANSITION_PAUSES == {"smooth": 0.2, "gradual": 0.4, "sudden": 0.6, "dramatic": 0.8, "resolution": 0.5}
