"""Documents with every odd case, and texts that repeat passages."""

import random
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, block int, shard int, a long, key string"


def odd_documents(spark, seed: int = 0, n: int = 60):
    """(DataFrame, rows): nulls, empty texts, short and long ones, copies, near copies, repeated rows, odd bytes, clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta eta", "漢字", "x", "the", "of"] + [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \t\n ", "one", "two words", "a" * 300, passage, passage, passage.upper(), "\x00\x1f" * 40]
    while len(texts) < n:
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
        if rng.random() < 0.4:
            t = f"{t} {passage} {t[:30]}"
        if rng.random() < 0.2 and texts[-1]:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        texts.append(t)
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(6000)) + passage)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[12], rows[13], (None, passage), (None, passage), (None, passage[:200]), (None, None)]
    rows += [(200, passage)] * 5 + [(201, f"{passage} {k}") for k in range(3)] + [(202, passage[::-1]), (203, passage[::-1]), (203, "another text of the same id that is like none of the others at all")]
    for n_letters in (1024, 2048, 4096):
        rows += [(300 + n_letters, thue_morse(n_letters)), (301 + n_letters, thue_morse(n_letters, 1)), (302 + n_letters, " ".join(thue_morse(n_letters)))]
    for k, w in enumerate(("q" * 1500, "r" * 1499 + "s", "t" * 64, "t" * 65)):
        rows.append((9000 + k, " ".join([w] * 30 + ["end", w])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", None, 1, 2, 3, "x") for k, (i, t) in enumerate(rows)], ODD).repartition(5)
    return df, rows


def thue_morse(n, first=0):
    """The first letters of the word whose halves are complements, on which polynomial hashes modulo 2 ** 64 collide."""
    return "".join("ab"[(k.bit_count() + first) & 1] for k in range(n))


def spark_hash(text):
    """xxhash64 of a string column's value, unsigned."""
    return 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)


def words(text):
    return WORDS.findall(text or "")
