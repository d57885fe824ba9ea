import random

import pytest

LANGUAGES = {
    "en": "the of and to in that house river walking green mountain letter reading quickly never always window morning people "
          "children street garden water thinking brought should would could night under bridge forest",
    "de": "der die und nicht eine ist haus fluss gehen grüner berg brief lesen schnell niemals immer fenster morgen leute kinder "
          "straße garten wasser denken gebracht sollte würde könnte nacht unter brücke wald",
    "fr": "le la et les une est maison rivière marcher vert montagne lettre lire rapidement jamais toujours fenêtre matin gens "
          "enfants rue jardin eau penser apporté devrait voudrait pourrait nuit sous pont forêt",
}


def prose(lang: str, n: int, seed: int) -> str:
    words = LANGUAGES[lang].split()
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    base = prose("en", 60, 1)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "..!"), (7, "word"), (None, base), (None, None),
            (8, prose("de", 40, 2)), (9, prose("en", 30_000, 3)), (10, "x" * 20_000), (11, base + " and one more word here")]
    schema = ("doc_id long, text string, lang string, class long, size int, row long, key string, target boolean, `hash` long, "
              "tile string, n long, root long, score double, d string, p string, s string")
    return spark.createDataFrame([(i, t, "en" if t else None, 1, 1, 1, "k", True, 1, "t", 1, 1, 0.5, "d", "p", "s") for i, t in rows],
                                 schema)
