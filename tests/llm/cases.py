import random


SYLLABLES = "an re ou th ti on é ça ñ 字 x# 0 A".split()


def make_docs(n=60, seed=1, size=80):
    """Small texts with shared passages, copies, near copies, repeated lines, spaces of all kinds, nulls and empties."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
    passages = [[word() for _ in range(r.randint(25, 60))] for _ in range(3)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, size))]
        if i % 3 == 0:
            k = r.randint(0, len(w))
            w[k:k] = r.choice(passages)
        if i % 7 == 0 and docs:
            w = (r.choice(docs)[1] or "").split() or w
            if w and i % 2:
                w[r.randrange(len(w))] = word()
        docs.append((i, "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)))
    docs[5] = (5, None)
    docs[6] = (6, "")
    docs[8] = (8, "a" * 300)
    docs[9] = (9, "ab c " * 120)
    docs[10] = docs[11][0] - 1, docs[11][1]
    return docs


