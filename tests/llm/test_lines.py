from __future__ import annotations

from flowsight.llm import lines


def brute(docs, least=1):
    seen, out = {}, []
    for k, (doc_id, text) in enumerate(docs):
        parts = (text or "").split("\n")
        at, spans, kept = 0, [], []
        for j, line in enumerate(parts):
            end = at + len(line) + (j < len(parts) - 1)
            ws = line.encode().split()
            norm = b" ".join(ws).decode().lower()
            if len(ws) >= least and seen.setdefault(norm, (doc_id, at)) != (doc_id, at):
                spans.append((at, end))
            else:
                kept.append(text[at:end] if text is not None else "")
            at = end
        out.append((doc_id, None if text is None else "".join(kept), spans))
    return out


def test_matches_brute_force(make_docs):
    passage = " ".join(f"Word{k}" for k in range(60))
    docs = [
        (1, f"first line of this text\n{passage}\nend"), (2, f"{passage.upper()}\n\n{passage}"), (3, "a b\na b\na b"), (4, None),
        (5, ""), (6, "first  line of\tthis TEXT"), (7, "é ü ß one two\né ü ß one two\nx"), (8, f"{passage}\n"), (9, "\n\n"),
    ]
    found = sorted((r.doc_id, r.text, [(s.start, s.stop) for s in r.spans]) for r in lines.dedup_lines(make_docs(docs)).collect())
    assert found == brute(docs)
    found = sorted((r.doc_id, r.text, [(s.start, s.stop) for s in r.spans]) for r in lines.dedup_lines(make_docs(docs), 5).collect())
    assert found == brute(docs, 5)


def test_offsets_point_into_the_original(make_docs):
    docs = dict([(1, "a line that will come again"), (2, "ünïcode 😀 before\nA line that will come again\nafter")])
    row = next(r for r in lines.dedup_lines(make_docs(list(docs.items()))).collect() if r.doc_id == 2)
    assert [docs[2][s.start : s.stop] for s in row.spans] == ["A line that will come again\n"]
    assert row.text == "ünïcode 😀 before\nafter"


def test_repeated_rows_and_empty_table(make_docs):
    docs = [(1, "one two three four five"), (1, "one two three four five")]
    assert [r.text for r in lines.dedup_lines(make_docs(docs)).collect()] == ["one two three four five"] * 2
    assert lines.dedup_lines(make_docs(docs).limit(0)).collect() == []


def test_texts_that_share_an_id_keep_their_own_lines(make_docs):
    line, other = "one two three four five", "a text with no line that comes again, of some length"
    docs = [(1, f"{line}\nfirst"), (2, f"{line}\nsecond"), (2, other), (None, f"{line}\nx"), (None, other.upper() + " twice")]
    found = sorted((r.text, [(s.start, s.stop) for s in r.spans]) for r in lines.dedup_lines(make_docs(docs)).collect())
    gone = [(0, len(line) + 1)]
    assert found == sorted([("first", gone), ("second", gone), (other, []), (f"{line}\nx", []), (other.upper() + " twice", [])])
