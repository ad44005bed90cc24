import random
import re

import pytest
from pyspark.sql import functions as F

from pairsift.functions import syllables
from pairsift.functions.readability import fk_grade
from pairsift.functions.text import words
from pairsift.operators.detectors import readability_mismatch
from pairsift.plans.pipeline import run_detector

# Words and how many syllables they have.
KNOWN = """
the:1 a:1 and:1 people:2 water:2 table:2 apple:2 little:2 middle:2 uncle:2 make:1 makes:1 made:1 time:1 times:1 horse:1 horses:2 change:1 changes:2
changed:1 walked:1 wanted:2 needed:2 called:1 settled:2 handled:2 tables:2 lion:2 violin:3 radio:3 period:3 nation:2 station:2 vision:2 religion:3
region:2 union:2 million:2 opinion:3 onion:2 curious:3 serious:3 delicious:3 anxious:2 various:3 science:2 patient:2 ancient:2 quiet:2 diet:2
society:4 variety:4 client:2 experience:4 audience:3 efficient:3 happier:3 happiest:3 priest:1 soldier:2 carrier:3 twentieth:3 believe:2 friend:1
field:1 movie:2 create:2 creation:3 creature:2 real:1 reality:4 idea:3 area:3 theater:3 ocean:2 great:1 tea:1 sea:1 react:2 linear:3 nuclear:3 bread:1
video:3 stereo:3 theory:3 people:2 pigeon:2 geography:4 museum:3 nucleus:3 being:2 seeing:2 going:2 doing:2 poem:2 poet:2 poetry:3 heroic:3
cooperate:4 coexist:3 boat:1 coin:1 food:1 house:1 boy:1 royal:2 mayor:2 player:2 beyond:2 employed:2 played:1 eye:1 eyes:1 yes:1 yellow:2 year:1
young:1 buy:1 usual:3 actual:3 manual:3 january:4 graduate:3 situation:4 language:2 quality:3 equal:2 guard:1 persuade:2 cruel:2 fuel:2 influence:3
blue:1 true:1 value:2 issue:2 continue:3 argued:2 question:2 queen:1 guess:1 guest:1 tuesday:2 continuous:4 quote:1 vacuum:3 fluid:2 ruin:2 fruit:1
build:1 guide:1 suicide:3 arguing:3 genuine:3 chaos:2 naive:2 mosaic:3 be:1 he:1 me:1 we:1 she:1 acre:2 centre:2 recipe:3 maybe:2 red:1 bed:1 shed:1
hundred:2 sacred:2 naked:2 wicked:2 element:3 implement:3 movement:2 statement:2 settlement:3 careful:2 useless:2 lovely:2 completely:3 awareness:3
something:2 somewhere:2 someone:2 whereas:2 therefore:2 homework:2 lifetime:2 safety:2 ninety:2 every:2 everything:3 evening:2 business:2 wednesday:2
tourism:3 prism:2 rhythm:2 algorithm:4 didn't:2 isn't:2 couldn't:2 information:4 university:5 computer:3 education:4 government:3 important:3
different:3 together:3 remember:3 family:3 animal:3 beautiful:3 understand:3 interesting:4 communication:5 responsibility:6 technology:4 environment:4
development:4 political:4 economic:4 international:5 philosophical:5 epistemological:7 reconceptualization:8 quantum:2 necessitate:4 fundamental:4
deterministic:5 phenomena:4 observable:4 cat:1 dog:1 sat:1 on:1 mat:1 ran:1 sun:1 fun:1 day:1 quick:1 brown:1 fox:1 jumps:1 over:2 lazy:2 sunny:2
meadow:2 weather:2 today:2 warm:1 city:2 capital:3 paris:2 france:1 computing:3 uses:2 parallel:3 computation:4 mother:2 father:2 brother:2 sister:2
teacher:2 student:2 school:1 college:2 country:2 world:1 number:2 never:2 always:2 often:2 because:2 before:2 after:2 again:2 against:2 between:2
another:3 however:3 although:2 though:1 through:1 thought:1 enough:2 cough:1 laughed:1 crying:2 studying:3 carrying:3 studied:2 tried:1 tries:1
carries:2 species:2 series:2 media:3 giant:2 social:2 special:2 initial:3 appreciate:4 marriage:2 parliament:3 familiar:3 brilliant:2 physician:3
piano:3 dial:2 champion:3 patriot:3 behavior:3 senior:2 junior:2 fashion:2 medium:3 stadium:3 skiing:2 deity:3 courageous:3 gorgeous:2 simultaneous:5
fire:1 hour:1 power:2 flower:2 fewer:2 jewel:2 owed:1 owe:1 one:1 none:1 done:1 does:1 goes:1 shoes:1 toe:1 free:1 agree:2 agreed:2 agreement:3
freedom:2 coffee:2 employee:3 committee:3 judge:1 judges:2 boxes:2 wishes:2 churches:2 prizes:2 places:2 names:1 lives:1 loved:1 lived:1 used:1
closed:1 noises:2
"""


def plain_syllables(word):
    """The patterns applied one by one, place by place."""
    out = 0
    padded = "." + re.sub("[^a-z]", ".", word.lower().translate(str.maketrans(*syllables.MARKED))) + "."
    best = {}
    for pattern in syllables.PATTERNS:
        before, priority, behind = syllables.placed(pattern)
        at = padded.find(before + behind)
        while at >= 0:
            best[at + len(before)] = max(best.get(at + len(before), 0), priority)
            at = padded.find(before + behind, at + 1)
    out = sum(p % 2 for p in best.values())
    return max(1, out)


def counted(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("w", words("text"))
    found = rows.select("i", F.size("w").alias("n"), syllables.sentences("text").alias("sentences"), syllables.syllables(F.coalesce("text", F.lit(""))).alias("syllables"), fk_grade("text", F.col("w")).alias("grade"))
    return found.orderBy("i").collect()


def test_known_words(spark):
    known = [(w, int(n)) for w, n in (x.split(":") for x in KNOWN.split())]
    got = counted(spark, [w for w, _ in known])
    wrong = [(w, n, r["syllables"]) for (w, n), r in zip(known, got, strict=True) if r["syllables"] != n]
    assert len(known) > 300 and len(wrong) <= 0.03 * len(known), wrong


def test_one_expression_equals_the_patterns_one_by_one(spark):
    draw = random.Random(2)
    ends = ["e", "es", "ed", "ely", "ement", "ious", "ying", "le", "les", "sm", "n't", "-re", "É", "7", "?"]
    made = ["".join(draw.choice("aeiouybcdglmnqrstwxéÿ'.") for _ in range(draw.randrange(1, 9))) + draw.choice(ends) for _ in range(600)]
    for text, row in zip(made, counted(spark, made), strict=True):
        assert row["syllables"] == plain_syllables(text), text
    whole = " ".join(made)
    assert counted(spark, [whole])[0]["syllables"] == sum(map(plain_syllables, made))


# Texts and their words, sentences and syllables (of abbreviations as they are written).
TEXTS = [
    ("The cat sat on a mat. The dog ran in the sun. It was a fun day.", 17, 3, 17),
    ("The quick brown fox jumps over the lazy dog in the sunny meadow.", 13, 1, 17),
    ("Mr. Smith met Dr. Jones at the station. They spoke for an hour, e.g. about trains.", 16, 2, 18),
    ("Is this a question? Yes! It is.", 7, 3, 8),
    ('He said "Stop!" and left. Nobody moved.', 7, 2, 9),
    ("The government created a new committee... and nobody noticed", 9, 1, 18),
    ("J. R. R. Tolkien wrote many stories. Readers love the hobbits.", 11, 2, 16),
    ("Ünïcode wörds are fine, naïve café too.", 7, 1, 11),
    ("Version 3.14 costs 5.99 dollars.", 5, 1, 7),
    ("Quantum computing uses qubits for parallel computation (and others, vs. one)! Why?", 12, 2, 23),
    ("What?! No... Yes.", 3, 3, 3),
    ("Apples, pears, etc.", 3, 1, 4),
]


def test_grades_of_known_texts(spark):
    for (text, n, sentences, count), row in zip(TEXTS, counted(spark, [t[0] for t in TEXTS]), strict=True):
        assert (row["n"], row["sentences"], row["syllables"]) == (n, sentences, count), text
        assert row["grade"] == pytest.approx(0.39 * n / sentences + 11.8 * count / n - 15.59)


def test_texts_without_words(spark):
    for row in counted(spark, ["", None, " \n "]):
        assert (row["n"], row["sentences"], row["grade"]) == (0, 1, -15.59)
    assert [r["syllables"] for r in counted(spark, ["...", "--- !", "pst 42"])] == [1, 2, 2]


def test_hard_texts_have_higher_grades(spark):
    hard = "The epistemological ramifications of quantum superposition necessitate a fundamental reconceptualization of deterministic philosophical frameworks and their ontological presuppositions regarding observable phenomena."
    pairs = spark.createDataFrame([(1, hard, TEXTS[0][0]), (2, TEXTS[1][0], "A fast brown fox leaps over a sleepy dog in the warm field."), (3, "Too short", "Also short")], "example_id long, chosen string, rejected string")
    score = {r["example_id"]: r["score"] for r in run_detector(pairs, readability_mismatch()).signals.collect()}
    assert score[1] > 30 and abs(score[2]) < 5 and score[3] == 0.0
    # 21 words, 74 syllables, one sentence
    assert counted(spark, [hard])[0]["grade"] == pytest.approx(0.39 * 21 + 11.8 * 74 / 21 - 15.59, abs=0.6)
