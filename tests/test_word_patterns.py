import re

from harborline.functions import education
from harborline.functions.text import branching


def test_words_with_common_beginnings_are_read_once():
    assert branching(["bachelor", "bachelors", "ba", "b.a"]) == r"b(?:\.a|a(?:chelor(?:s)?)?)"
    words = sorted({p.split(" ")[0] for _, _, phrases in education.LEVELS for p in phrases})
    pattern = re.compile(branching(words))
    assert all(pattern.fullmatch(w) for w in words)
    near = {w[:-1] for w in words} | {w + "x" for w in words} | {w.replace(".", "x") for w in words} | {""}
    assert [w for w in near - set(words) if pattern.fullmatch(w)] == []
