"""Alignment against a plain version with both libraries' own files."""

import bisect
import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tests_data import DATA
from tokenizers import Tokenizer

from tessera.llm import alignment, queries

ODD = ["", None, "a", " ", "  two  spaces\n\n", "<|endoftext|> </s> <s> <unk> <0x41>", "▁mark", "日本語のテキスト 🙂🙃", "x" * 3000, "\x00\x01 controls\r\n", "naïve café — “quotes”", "é ﬁ", "1234567890 " * 300]


def plain(rows):
    """Per document, by sets of ends; A through the tokenizers file."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, names = alignment._byte_alphabet(), {i: t for t, i in own.get_vocab().items()}
    as_bytes = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for doc, text in rows:
        a = own.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        sides = [[(i, bytes(alphabet[c] for c in names[i])) for i in a], [(i, as_bytes(i)) for i in b]]
        data = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in s) != data for s in sides):
            out.append([doc, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ends = [{}, {}]
        for side, own_ends in zip(sides, ends, strict=True):
            at = 0
            for i, t in side:
                at += len(t)
                own_ends[at] = i
        both = sorted(set(ends[0]) & set(ends[1]))
        parts = collections.defaultdict(lambda: ([], []))
        for k, own_ends in enumerate(ends):
            for e in sorted(own_ends):
                parts[both[bisect.bisect_left(both, e)]][k].append(str(own_ends[e]))
        parts = [f"{','.join(x)}|{','.join(y)}" for _, (x, y) in sorted(parts.items())]
        links.append([(ends[0][e], ends[1][e]) for e in both])
        out.append([doc, len(a), len(b), len(both), len(both), hashlib.sha256(";".join(parts).encode()).hexdigest()])
    counts = collections.Counter(x for own_links in links for x in own_links)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(tuple(r[:5] + [sum(counts[x] == best[x[1]] for x in own_links), sum(counts[x] for x in own_links), r[5]]) for r, own_links in zip(out, links, strict=True))


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))


def files():
    return alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def test_equals_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 4000").select("doc_id", "text").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(alignment.align_corpus(frame, files())) == plain(rows)


def test_pieces_of_any_size_agree():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, 40))), n)) for _ in range(2))
        want = sorted(set(a.tolist()) & set(b.tolist()))
        for step in (1, 2, 3, 7, 1000):
            x, y = alignment.common_ends(a, b, step)
            assert a[x].tolist() == want == b[y].tolist()


def test_diagonals_are_equal_work():
    a, b = np.arange(1, 10001), np.arange(1, 10001, 7)
    i, j = alignment.diagonals(a, b, 64)
    assert set(np.diff(i + j)[:-1].tolist()) == {64} and all(x <= y for x, y in zip(a[i[1:-1] - 1], b[j[1:-1]], strict=True))


def test_both_forms_of_a_agree():
    own = alignment.vocabularies(files())
    other = alignment.Vocabularies(alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), files().b))
    texts = [t or "" for t in ODD]
    assert own.encode(texts) == other.encode(texts) and len(own.pairs) < 600_000


def test_long_text_and_written_groups(spark):
    text = "Long words and short ones, ünïcödé too. " * 20_000
    rows = alignment.align_texts([text, "", text], alignment.vocabularies(files()), step=1000, written=True)
    a, b = zip(*[g.split("|") for g in rows[0][6].split(";")], strict=True)
    own = alignment.vocabularies(files())
    back = lambda ids, t: b"".join(t[int(i)] for g in ids for i in g.split(","))
    assert back(a, own.bytes_a) == back(b, own.bytes_b) == (" " + text).encode() and rows[0][:4] == rows[2][:4] and rows[1][:3] == (0, 0, 0)


def test_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_a int, links string")
    assert alignment.align_corpus(empty, files()).count() == 0
    clash = spark.createDataFrame([(1, "one two", 9, "x"), (None, None, 1, "y")], "doc_id long, text string, n_a int, links string")
    assert [r[:2] for r in found(alignment.align_corpus(clash.filter("doc_id is not null"), files()))] == [(1, 2)]
    assert alignment.align_corpus(clash, files()).filter("doc_id is null and n_a = 0 and groups_sha256 = ''").count() == 1
    assert queries.QUERIES["op13_alignment"]
