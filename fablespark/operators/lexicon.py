"""Emotion by lexicon, intensity, onomatopoeia and the French word lists of narrative types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values: (keywords, patterns) by emotion, in the order that breaks ties; boosters; imitations of sounds.
LEXICON = {
    "fr": {
        "joy": (("heureux", "heureuse", "joie", "bonheur", "content", "contente", "ravi", "ravie", "enchante", "enchantee", "merveilleux", "magnifique", "formidable", "genial", "super", "fantastique", "excellent", "extraordinaire", "parfait", "sublime", "delicieux", "sourire", "rire", "eclat", "rayonnant", "epanoui", "comble", "jubiler"), (r"!\s*$", r":-?\)", r"sourire|rire|rigoler")),
        "sadness": (("triste", "malheureux", "malheureuse", "chagrin", "peine", "desespoir", "melancolie", "nostalgie", "larme", "pleurer", "sanglot", "deuil", "affliction", "accable", "abattu", "deprime", "morose", "sombre", "desole", "navrant", "lamentable", "pitoyable", "regret", "remords"), (r"helas", r"malheureusement", r":-?\(")),
        "anger": (("colere", "furieux", "furieuse", "rage", "enerve", "enervee", "agace", "agacee", "irrite", "irritee", "exaspere", "excede", "outrage", "indigne", "revolte", "furibond", "enrage", "courroux", "emporte", "violent", "brutal", "detester", "hair"), (r"!{2,}", r"comment oses?-tu", r"assez\s*!")),
        "fear": (("peur", "terreur", "effroi", "angoisse", "anxiete", "crainte", "frayeur", "epouvante", "terrifie", "terrifiee", "apeure", "trembler", "frissonner", "palir", "glacer", "paralyse", "petrifie", "horrifie", "panique", "affolement"), (r"mon dieu", r"au secours", r"a l'aide")),
        "surprise": (("surpris", "surprise", "etonne", "etonnee", "stupefait", "sidere", "abasourdi", "ebahi", "interdit", "decontenance", "incroyable", "inimaginable", "inattendu", "soudain"), (r"\?!", r"!\?", r"quoi\s*[?!]", r"comment\s*[?!]")),
        "disgust": (("degout", "degoute", "repugnant", "ecoeurer", "repulsion", "abject", "ignoble", "immonde", "infect", "nauseabond", "repugnance", "aversion", "horreur"), (r"beurk", r"pouah", r"quelle horreur")),
        "excitement": (("excite", "excitee", "enthousiaste", "impatient", "impatiente", "febrile", "ardent", "passionne", "enflamme", "exalte", "transporte", "galvanise", "electrise"), (r"!{2,}", r"vite", r"enfin\s*!")),
        "tenderness": (("tendre", "tendresse", "doux", "douce", "affection", "amour", "caresse", "cajoler", "cherir", "adorer", "aime", "aimee", "precieux", "cher", "chere", "bien-aime", "attachement"), (r"mon (cher|amour|coeur)", r"ma (chere|cherie)")),
        "suspense": (("soudain", "tout a coup", "brusquement", "subitement", "silence", "immobile", "fige", "retenir son souffle", "attendre", "guetter", "epier", "mysterieux", "etrange"), (r"\.\.\.$", r"—$", r"puis,?\s*$")),
        "irony": (("ironique", "sarcastique", "moqueur", "railleur", "cynique", "persiflage", "derision"), (r"bien sur", r"evidemment", r"naturellement")),
    },
    "en": {
        "joy": (("happy", "joyful", "delighted", "pleased", "glad", "cheerful", "elated", "ecstatic", "thrilled", "wonderful", "amazing", "fantastic", "excellent", "perfect", "brilliant", "smile", "laugh", "grin", "beam", "radiant"), (r"!\s*$", r":-?\)", r"smil|laugh|grin")),
        "sadness": (("sad", "unhappy", "miserable", "depressed", "melancholy", "grief", "sorrow", "tears", "cry", "weep", "sob", "heartbroken", "devastated", "gloomy", "mournful"), (r"alas", r"unfortunately", r":-?\(")),
        "anger": (("angry", "furious", "enraged", "mad", "outraged", "irritated", "annoyed", "exasperated", "infuriated", "livid", "seething", "hate", "detest", "loathe"), (r"!{2,}", r"how dare", r"enough\s*!")),
        "fear": (("afraid", "scared", "terrified", "frightened", "fearful", "anxious", "nervous", "worried", "panicked", "horrified", "trembl", "shiver", "pale", "frozen"), (r"oh god", r"help", r"oh no")),
        "surprise": (("surprised", "astonished", "amazed", "shocked", "stunned", "startled", "bewildered", "dumbfounded", "incredible", "unbelievable", "unexpected", "sudden"), (r"\?!", r"!\?", r"what\s*[?!]", r"how\s*[?!]")),
        "excitement": (("excited", "thrilled", "eager", "enthusiastic", "passionate", "energetic", "animated", "exhilarated"), (r"!{2,}", r"finally\s*!", r"yes\s*!")),
        "tenderness": (("tender", "gentle", "soft", "loving", "affectionate", "caring", "sweet", "dear", "darling", "beloved", "cherish"), (r"my (dear|love|darling)", r"sweetheart")),
        "suspense": (("suddenly", "abruptly", "silence", "still", "frozen", "waiting", "watching", "mysterious", "strange", "eerie"), (r"\.\.\.$", r"—$", r"then,?\s*$")),
    },
}
BOOSTERS = {
    "fr": ("tres", "vraiment", "absolument", "completement", "totalement", "extremement", "incroyablement", "terriblement", "affreusement", "horriblement", "tellement", "si", "tant", "trop"),
    "en": ("very", "really", "absolutely", "completely", "totally", "extremely", "incredibly", "terribly", "awfully", "so", "such"),
}
SOUNDS = {
    "fr": ("bang", "boum", "paf", "vlan", "clac", "crac", "plouf", "splash", "pschitt", "vroum", "bip", "ding", "dong", "tic-tac", "toc-toc", "pan", "pif", "pouf", "badaboum", "miaou", "ouaf", "cocorico", "meuh", "beeeh", "coin-coin", "cui-cui", "croâ", "hou-hou", "grr", "sss", "ouf", "pfff", "bof", "hum", "euh", "ah", "oh", "aie", "ouille", "oups", "chut", "psst", "hep", "ha ha", "hi hi", "ho ho", "hé hé"),
    "en": ("bang", "boom", "crash", "splash", "whoosh", "zoom", "beep", "ding", "dong", "tick-tock", "knock-knock", "pow", "wham", "zap", "buzz", "hiss", "roar", "meow", "woof", "moo", "baa", "quack", "chirp", "oops", "shh", "psst", "hey", "wow", "ouch", "ha ha", "hee hee", "ho ho"),
}
FRENCH_NARRATIVE = {
    "action": ("courir", "sauter", "frapper", "lancer", "attraper", "bondir", "esquiver", "fuir", "poursuivre", "se jeter", "s'elancer", "degainer", "tirer", "exploser", "s'ecraser", "percuter", "foncer", "sprinter", "plonger", "rouler", "se relever"),
    "description": ("etait", "semblait", "paraissait", "ressemblait", "avait l'air", "se trouvait", "s'etendait", "dominait", "surplombait", "ornait", "decorait", "baignait", "flottait"),
    "introspection": ("pensait", "songeait", "reflechissait", "se demandait", "se souvenait", "revoyait", "imaginait", "revait", "se rappelait", "comprenait", "realisait", "savait"),
    "thoughts": (r"pensa-t-(?:il|elle)", r"se dit-(?:il|elle)", r"songea-t-(?:il|elle)", r"se demanda-t-(?:il|elle)", r"il se dit", r"elle se dit"),
    "flashback": (r"il y a (?:longtemps|des annees|des mois)", r"autrefois", r"jadis", r"a cette epoque", r"en ce temps-la", r"il se souvenait", r"le souvenir", r"dans sa memoire"),
}


def keywords(lang: str, emotion: str) -> tuple[str, ...]:
    return LEXICON[lang][emotion][0]


def folded(text: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(T.col(text)), ACCENTED, PLAIN)


# Accented letters and what they are without their accents.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def lexicon_emotion(text: Column | str, lang: str = "fr") -> Column:
    """struct(emotion, confidence): 1 for a keyword, 0.3 more at either end of the text, 0.5 for a pattern.

    The first listed of equal emotions wins; neutral with confidence 0 where nothing is found.
    """
    t = T.col(text)

    def best(low: Column) -> Column:
        scores = []
        for i, (name, (_, patterns)) in enumerate(LEXICON[lang].items()):
            words = F.array(*map(F.lit, keywords(lang, name)))
            found = F.aggregate(F.filter(words, lambda w: F.contains(low, w)), F.lit(0.0), lambda sum_, w: sum_ + F.when(F.startswith(low, w) | F.endswith(low, w), 1.3).otherwise(1.0))
            marked = reduce(lambda a, b: a + b, [t.rlike(f"(?iu){p}").cast("int") * 0.5 for p in patterns])
            scores.append(F.struct(F.round(found + marked, 6).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("emotion")))
        return F.array_max(F.array(*scores))

    return T.let(
        T.let(folded(t), best),
        lambda x: F.struct(F.when(x["score"] > 0, x["emotion"]).otherwise("neutral").alias("emotion"), F.least(x["score"] / 3, F.lit(1.0)).alias("confidence")),
    )


def lexicon_intensity(text: Column | str, lang: str = "fr") -> Column:
    """low, medium, high or extreme by marks, words in capitals, boosters and a word that comes twice on a line."""
    t = T.col(text)
    marks = F.when(t.rlike("[!?]{2,}"), 2.0).when(t.rlike("[!?]"), 1.0).otherwise(0.0)
    loud = F.size(F.filter(T.words(t), lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w))))
    boost = T.let(folded(t), lambda low: F.size(F.filter(F.array(*map(F.lit, BOOSTERS[lang])), lambda b: F.contains(low, b))))
    again = t.rlike(r"(?iuU)\b(\w+)\b.*\b\1\b")
    score = marks + F.when(t.contains("..."), 0.5).otherwise(0.0) + loud + boost + F.when(again, 0.5).otherwise(0.0)
    return T.let(score, lambda s: F.when(s >= 4, "extreme").when(s >= 2, "high").when(s >= 1, "medium").otherwise("low"))


def onomatopoeia(text: Column | str, lang: str = "fr") -> Column:
    """struct(found, ratio): listed sounds in the text for each word; found where the ratio is over 0.3."""
    t = T.col(text)
    n = T.let(F.lower(t), lambda low: F.size(F.filter(F.array(*map(F.lit, SOUNDS[lang])), lambda s: F.contains(low, s))))
    return T.let(n / F.greatest(T.word_count(t), F.lit(1)), lambda r: F.struct((r > 0.3).alias("found"), r.alias("ratio")))


def french_hits(text: Column | str, kind: str) -> Column:
    """How many of the French words or patterns of a narrative type a text holds."""
    low = F.lower(T.col(text))
    if kind in ("thoughts", "flashback"):
        return reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in FRENCH_NARRATIVE[kind]])
    return T.let(low, lambda x: F.size(F.filter(F.array(*map(F.lit, FRENCH_NARRATIVE[kind])), lambda w: F.contains(x, w))))
