import random
import re

from weirloom.llm import ngram_join


def brute(rows):
    grams = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(g), None if d is None else least[find(i)]) for i, ((d, _), g) in enumerate(zip(rows, grams))), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in ngram_join.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_hard_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "One  TWO\n"), (12, "two one"), (13, "a b c d e"), (14, "a b c d E "), (13, "a b c d e"), (None, "a b c d e"), (15, "É É É É É É É"), (16, "é é é é é é é")]
    assert run(spark, rows) == brute(rows)


def test_random_near_copies(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
            rows.append((1000 - i, " ".join(own)))
            i += 1
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


def test_chains_across_groups(spark):
    # each neighbour links with the next only, so the component is a path
    words = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(40)]
    got = run(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {0}


def test_empty_table(spark):
    assert run(spark, []) == []
