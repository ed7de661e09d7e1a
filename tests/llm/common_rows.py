"""A small table with every awkward row: nulls, empties, repeats, copies, long texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, n long, key long, bucket long, grp string"


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def documents():
    base = words(1, 120)
    near = list(base)
    near[60] = "changed"
    far = base[:50] + words(2, 70)
    texts = [" ".join(base), " ".join(near).upper(), " ".join(far), " ".join(base), None, "", " \t\n", "one two", "ONE two", "one\ttwo", "x" * 60_000, " ".join(words(3, 8_000, 3_000)), " ".join(base[20:100])]
    rows = [(100 - i, t, "en", 1, 2, 3, "g") for i, t in enumerate(texts)]
    rows += [rows[0], (None, " ".join(base), "en", 1, 2, 3, "g"), (-7, " ".join(words(4, 40) + base[:40]), None, None, None, None, None)]
    rows += [(1000 + i, " ".join(base[:-1] + [f"copy{i}"]), "en", 1, 2, 3, "g") for i in range(30)]
    return rows


def twins(order):
    """Two words of 2**order letters, the Thue-Morse word and its complement: codes that are polynomials over 2**64 coincide."""
    bits = [bin(i).count("1") % 2 for i in range(1 << order)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
