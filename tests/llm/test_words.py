"""Words by their parts: the tokenizer's own ids, and words that tasks share."""

import numpy as np

from gleanery.llm import packing


def test_words_with_marks_are_tokenized_by_parts():
    path = packing.tokenizer_path()
    known = packing.known_words(path)
    assert packing.known_words(path) is known
    texts = ["ones,### x&&& Bleea### 555-0546%%% ab%%% c.*** d$$$", "e_f g-h i's j'll k''", "Zürich[1] naïve{} ~a ^b` É\\ l<=>m n@@ o/", "ieversch&&& don't. 'quoted' p'", "a*b **c** #d# %e%"]
    for t in texts:
        assert known.ids(t).tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    for a in marks:
        for w in (f"Word{a}", f"é{a}{a}.", f"{a}x{a}"):
            assert known.ids(w).tolist() == known.tokenizer.encode(w, add_special_tokens=False).ids
    assert {"###", "&&&", "%%%"} <= set(known.parts)  # once for all words that end so


def test_remembered_words_give_the_same_ids(monkeypatch):
    known = packing.WordTokens(packing.tokenizer_path())
    text = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}, x{i}" for i in range(300))
    want = known.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    assert np.array_equal(known.ids(text), want) and np.array_equal(known.ids(text), want) and len(known) <= 300
