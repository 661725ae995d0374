"""Token ids by tables of units."""

import corpus_pipeline

from vectorloom.llm import packing, tokens


def test_words_of_letters_are_not_cut(monkeypatch):
    """Words of plain letters are one piece; a table makes what is missing, in its bytes, and the
    ids are the library's whatever was kept."""
    cut = []

    class Recording:
        def findall(self, text, pattern=tokens._PIECES):
            cut.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(tokens, "_PIECES", Recording())
    texts = ["plain words here", "don't  cut, naïve", "漢字 мир 🙂 word", " lead", "", None,
             "a\tb \n c", "x" * 200 + " " + "ж" * 100, "<|endoftext|> it's"] * 2
    path = tokens.default_vocabulary()
    for size in (1 << 20, 500):
        encoder = tokens.Encoder(path, size, size)
        whole = encoder._library([t or "" for t in texts])
        assert encoder.encode(texts) == whole
        assert encoder.known.held <= size and encoder.pieces.held <= size
    assert not {"plain", " words", " here", " word", " lead"} & set(cut)
    assert {" don't"} <= {" " + c.strip() for c in cut}


def test_tables_hold_what_they_are_given(monkeypatch):
    """A worker's one encoder keeps as many bytes as it is given for the task; ids do not change."""
    monkeypatch.setattr(tokens, "_encoders", {})
    path = tokens.default_vocabulary()
    texts = [" ".join(f"w{i}x{i * 7919} {chr(97 + i % 26) * (i % 9 + 1)}," for i in range(lo, lo + 500))
             for lo in range(0, 5000, 500)]
    wide = tokens.Encoder.of(path)
    want = wide.encode(texts)
    assert wide.known.held + wide.pieces.held > 1 << 20
    less = tokens.Encoder.of(path, 1 << 18)
    assert less is wide and less.known.held + less.pieces.held <= 1 << 18
    assert less.encode(texts) == want == less._library(texts)
    assert less.known.held + less.pieces.held <= 1 << 18
    assert tokens.Encoder.of(path).known.most == tokens.UNIT_BYTES


def test_pipeline_packs_with_small_tables(monkeypatch):
    """Two workers' tables fit beside a heap that the earlier stages have filled."""
    given = []
    monkeypatch.setattr(packing, "pack", lambda docs, **options: given.append(options))
    corpus_pipeline.sequence_packing(None, None, "")
    assert given[0]["table_bytes"] <= 64 << 20
