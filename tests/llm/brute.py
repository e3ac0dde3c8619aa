"""The plain versions that operators are held against."""

import random
import re
from collections import Counter

SPACES = r"[^\x20\x09-\x0D]+"


def corpus(seed: int = 3) -> list[tuple]:
    """(doc_id, text): prose with exact and near copies, shared passages, junk and edge cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = prose(60), prose(200)
    out = [None, "", " \n\t ", "one", "one", "a b c d", "a b c d", "x " * 3000, "\x85  nb\x1csp", "😀 " * 50 + "end"]
    for i in range(40):
        words = prose(rng.randint(3, 300))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) :]
        out.append((" " if i % 3 else "\n").join(words))
    for _ in range(12):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edit"
        out.append(" ".join(words))
    out += [" ".join(base)] * 5 + [out[12]] * 3 + [" ".join(prose(15_000)), "Ab" * 40_000, " " * 40_000 + "z", "it's " * 9000]
    rng.shuffle(out)
    return list(enumerate(out))


def words(text):
    return re.findall(SPACES, text or "")


def shingles(text):
    w = bench_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes_of(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root, degree = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}, degree


def removed(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = words(texts[i]), set()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone.update(range(a, a + window))
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
