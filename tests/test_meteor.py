"""METEOR's alignment as a relation against a search from both texts' ends."""

import random

from qaloom.functions.porter import stem
from qaloom.operators import metrics


def library_pairs(p, r, classes):
    """The pairing of the reference's library: from the last word of the prediction the last word of the reference that fits."""
    left, right, pairs = list(enumerate(p)), list(enumerate(r)), []
    for same in (lambda a, b: a == b, lambda a, b: stem(a) == stem(b), lambda a, b: a in classes and classes[a] == classes.get(b)):
        for x in left[::-1]:
            for y in right[::-1]:
                if same(x[1], y[1]):
                    pairs.append((x[0], y[0]))
                    left.remove(x)
                    right.remove(y)
                    break
    return sorted(pairs)


def test_alignment(spark):
    rng = random.Random(2)
    words = ["lung", "lungs", "nodule", "nodules", "mass", "left", "right", "the", "The", "a", "lesion", "seen"]
    classes = {"nodule": "n", "mass": "n", "lesion": "n", "left": "s", "right": "s"}
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None, "x"), (101, "x", None), (102, "a a a", "a a"), (103, "a b a b", "b a b")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    synonyms = spark.createDataFrame(list(classes.items()), "word string, class string")
    got = {}
    for w in metrics.meteor_alignment(df, ["id"], synonyms=synonyms).where("side = 'p' and other is not null").collect():
        got.setdefault(w.id, []).append((w.pos, w.other))
    scores = {r.id: r for r in metrics.meteor_aligned(df, ["id"], synonyms=synonyms).collect()}
    assert len(scores) == len(rows)
    for i, p, r in rows:
        a, b = (p or "").lower().split(), (r or "").lower().split()
        want = library_pairs(a, b, classes)
        assert sorted(got.get(i, [])) == want, (p, r)
        chunks = sum(1 for k, x in enumerate(want) if not k or want[k - 1] != (x[0] - 1, x[1] - 1))
        assert (scores[i].matched, scores[i].chunks) == (len(want), chunks)
        assert abs(scores[i].meteor - metrics.meteor_score(a, b, classes)) < 1e-9
