"""Leaks of edited passages in every language, and of items that repeat themselves."""

import random
from collections import Counter

import pyarrow.parquet as pq

from medlattice.llm import leaks


def test_edited_passages_in_every_language(root):
    """60 % of an item with one word in six dropped."""
    items = pq.read_table(f"{root}/eval_items.parquet").to_pylist()
    index = leaks.build_index([(r["item_id"], r["text"]) for r in items])
    asked, found = Counter(), Counter()
    for r in items:
        words, rng = r["text"].split(), random.Random(r["item_id"])
        k = int(len(words) * 0.6)
        first = rng.randrange(len(words) - k + 1)
        passage = " ".join(w for j, w in enumerate(words[first : first + k]) if (j + r["item_id"]) % 6)
        asked[r["lang"]] += 1
        found[r["lang"]] += r["item_id"] in {c[0] for c in leaks.judge(passage, index)}
    assert set(asked) >= {"de", "en", "es", "fr"}
    assert all(found[x] >= 0.9 * asked[x] for x in asked), (asked, found)


def test_predecessor_behind_many_runs():
    """Seventy other runs begin between the two halves of a passage."""
    item = [f"w{i}" for i in range(2000)]
    document = [*item[:5], "other", *item[6:10]]
    hits = [(d, d) for d in (0, 1, 2, 6, 7)] + [(3 + k % 3, 100 + 20 * k) for k in range(70)]
    made = leaks.stretches(item, document, sorted(hits), leaks.Rule(), item, document)
    assert [m[:4] for m in made] == [(0, 10, 0, 10)]
