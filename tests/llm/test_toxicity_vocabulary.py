"""The vocabulary: every telling term of the texts it is drawn from, no fixed number."""

import random
import zlib

from fathomgrid.llm import toxicity

IDS = [i for i in range(60_000) if zlib.crc32(str(i).encode()) % 5]


def fitted(spark, rows, **how):
    own = [(i, t, y) for i, (t, y) in zip(IDS, rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string").repartition(3)
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in own], "doc_id long, toxic int"), **how)


def word(n, letters="bcdfghjklm"):
    return "".join(letters[int(d)] for d in f"{n:05d}")


def test_no_fixed_number_of_terms(spark):
    # 5000 words tell, no two with the same four letters: each stands in some 12 toxic texts and in no other
    r = random.Random(2)
    telling = [word(10 * n, "npqrstvwxy")[:4] + "aaa" for n in range(5000)]
    toxic = [(" ".join(r.sample(telling, 100)), 1) for _ in range(600)]
    clean = [(" ".join(f"z{word(7 * i + k)}" for k in range(12)), 0) for i in range(3000)]
    assert len(fitted(spark, toxic + clean).vocabulary) > 4096


def test_drawn_texts_bound_the_terms(spark):
    toxic = [(word(10 * (i % 40), "npqrstvwxy") + " " + " ".join(f"t{word(50 * i + k)}" for k in range(9)), 1) for i in range(400)]
    clean = [(" ".join(f"z{word(9 * i + k)}" for k in range(9)), 0) for i in range(900)]
    whole, few = (fitted(spark, toxic + clean, **how) for how in ({}, {"max_examples": 10}))
    assert len(few.examples) == 10 and set(few.vocabulary) < set(whole.vocabulary)
    texts = {w for t, _ in toxic for w in toxicity.terms_of(t)}
    assert set(few.vocabulary) <= texts and few.prior == whole.prior
