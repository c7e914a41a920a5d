import hashlib
import re
from collections import defaultdict

import pytest
from corpus import hard, hard_rows, none

from trainlake.llm import textkit
from trainlake.llm.exact_dedup import exact_duplicates


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_groups_as_brute_force(spark, digest_bytes):
    """With digests of one byte most chunks collide, and only their bytes tell them apart."""
    found = exact_duplicates(hard(spark), digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in hard_rows():
        groups[bare(text)].append((-len(text or ""), doc_id is None, doc_id))
    sha = {hashlib.sha256(b.encode()).hexdigest(): b for b in groups}
    assert len(found) == len(hard_rows())
    for row in found:
        members = groups[sha[row.text_sha256]]
        assert row.keep_id == min(members)[2] and row.group_size == len(members)
    for b, members in groups.items():
        of_group = [r for r in found if sha[r.text_sha256] == b]
        assert sum(r.kept for r in of_group) == 1
        assert next(r for r in of_group if r.kept).doc_id == min(members)[2]


def test_empty_table(spark):
    assert exact_duplicates(none(spark)).count() == 0


def test_cuts_depend_on_content_only():
    data = bytes(range(256)) * 40 + hashlib.sha512(b"x").digest() * 200
    noise = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(2000))
    ends = textkit.cut_points(noise)
    shifted = textkit.cut_points(b"0123456789" + noise)
    assert ends[-1] == len(noise) and all(256 <= b - a <= 8192 for a, b in zip([0, *ends], ends[:-1]))
    assert len({e - 10 for e in shifted} & set(ends)) > 0.8 * len(ends)
    assert textkit.cut_points(data)[-1] == len(data) and textkit.cut_points(b"") == [] and textkit.cut_points(b"a") == [1]
