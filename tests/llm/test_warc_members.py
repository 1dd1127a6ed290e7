"""Members of an archive are read in time that follows its size."""

import os
import time
import zlib

import pytest

from weftline.llm import warc


@pytest.mark.parametrize("feed", [7, 1 << 16])
def test_members_come_back(monkeypatch, feed):
    monkeypatch.setattr(warc, "FEED", feed)
    parts = [b"", b"x", os.urandom(3000), b"ab" * 5000, b""]
    assert list(warc.members(b"".join(map(warc.gzipped, parts)))) == parts
    assert list(warc.members(b"")) == []
    with pytest.raises(ValueError):
        list(warc.members(warc.gzipped(b"some text that is cut")[:-3]))


def test_twice_the_members_take_about_twice_as_long():
    one = zlib.compress(os.urandom(200_000), 0, 31)

    def took(n):
        began = time.process_time()
        assert sum(len(m) for m in warc.members(one * n)) == 200_000 * n
        return time.process_time() - began

    took(16)
    assert min(took(512) for _ in range(2)) < 8 * min(took(128) for _ in range(2))
