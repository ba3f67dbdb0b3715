"""Golden words and texts (FIXTURES §3) through the full Spark normaliser."""

import pytest

GOLDEN_WORDS = [
    ("vdo", "video"), ("VDO", "VIDEO"), ("Vdo", "Video"), ("vDo", "video"),
    ("u", "u"), ("u,", "you,"), ("U!", "YOU!"), ("2", "2"), ("2,", "to,"), ("4ever", "4ever"),
    ("gr8", "great"), ("Gr8", "Great"), ("GR8!!", "GREAT!!"), ("Lol", "Laugh Out Loud"), ("LOL", "LAUGH OUT LOUD"),
    ('"nanri"', '"thanks"'), ("(plz)", "(please)"), ("plz...", "please..."), ("#hope", "#hope"), ("@dm", "@direct message"),
    ("***", "***"), ("--", "--"), ("_vdo_", "_vdo_"), ("thx,u", "thx,u"), ("don't", "don't"), ("video's", "video's"),
    ("hope-full", "hope-full"), ("adipoli", "excellent"), ("adipolli", "excellent"),
    ("would", "would have"), ("could", "could have"), ("should", "should have"),
    ("hopes", "hope"), ("dream", "dreams"), ("goal", "goals"), ("place", "peace"), ("subscribe", "subscriber"),
    ("friend", "friend"), ("believe", "believe"), ("please", "please"), ("strenght", "strenght"),
    ("voulda", "could have"), ("vedioz", "video"), ("encouragi", "encouraging"), ("mind-blowing", "mind blowing"),
    ("thankyou", "thank you"), ("thumbsup", "like"), ("thumbsdown", "dislike"), ("veralevel", "very good"),
    ("cool", "cool"), ("cooool", "cool"), ("coooool", "coooool"), ("nalllla", "good"), ("nallllla", "good"),
    ("masssssss", "awesome"), ("powerfulllll", "powerful"), ("niceeee", "nice"), ("niceeeee", "niceeeee"),
    ("superrrrr", "superrrrr"), ("soooooo", "soooooo"), ("pleassse", "pleassse"),
    ("வணக்கம்", "வணக்கம்"), ("நன்றி!", "நன்றி!"),
]

# Demo texts of the reference script (M7) with their normalised form (FIXTURES §3).
GOLDEN_TEXTS = [
    ("This video is vera level mass! Super content bro, keep inspiring us 🔥",
     "This video is very awesome awesome! Super content bro, keep inspiring us 🔥"),
    ("Nalla content da, very motivating and hopeful for young generation",
     "Good content da, very motivating and hopeful for young generation"),
    ("Semma video! This gives me hope and courage to achieve my dreams",
     "Awesome video! This gives me hope and courage to achieve my dreams"),
    ("Beautiful message, nanri for sharing such positive thoughts",
     "Beautiful message, thanks for sharing such positive thoughts"),
    ("Amazing work! This channel always encourages and supports everyone",
     "Amazing work! This channel always encourage and supportive everyone"),
]


@pytest.fixture(scope="module")
def word_results(spark, normalizer):
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(GOLDEN_WORDS)], "row_id long, text string")
    return {r.row_id: r.text for r in normalizer.normalize(df).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN_WORDS)))
def test_golden_word(word_results, i):
    word, expected = GOLDEN_WORDS[i]
    assert word_results[i] == expected, word


def test_golden_texts_and_blank_rows(spark, normalizer):
    rows = [(i, t) for i, (t, _) in enumerate(GOLDEN_TEXTS)] + [(90, None), (91, " \t\n "), (92, "")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    out = {r.row_id: (r.text, r.text_original) for r in normalizer.normalize(df).collect()}
    assert set(out) == set(range(len(GOLDEN_TEXTS)))  # blank / null rows removed (P2)
    for i, (t, expected) in enumerate(GOLDEN_TEXTS):
        assert out[i] == (expected, t)
