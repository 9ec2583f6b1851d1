import pytest

from lexiloom.functions.stem import measure, porter, stem_vocabulary

# Published examples of the algorithm's steps.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "causes": "caus", "provokes": "provok", "leads": "lead", "chases": "chase",
    "smoking": "smoke", "virus": "viru", "accompany": "accompani", "possibli": "possibl", "archaeologi": "archaeolog",
}


@pytest.mark.parametrize("word", KNOWN)
def test_published_examples(word):
    assert porter(word) == KNOWN[word]


def test_short_empty_and_null():
    assert [porter(w) for w in ("", None, "as", "is", "ies", "eed", "ing")] == ["", "", "as", "is", "i", "eed", "ing"]


def test_upper_case_letters_are_consonants():
    assert porter("RUNNING") == "RUNNING" and porter("Cats") == "Cat"


def test_measure():
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_vocabulary_runs_once_a_word(spark):
    rows = spark.createDataFrame([("causes",), ("causes",), (None,)], "w string")
    assert [tuple(r) for r in stem_vocabulary(rows, "w").collect()] == [("causes", "caus")]
