import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from harborline.llm import best_fit_packing, length_histogram, token_files
from harborline.llm.common import new_path
from harborline.llm.tokens import END_ID, encoder, vocabulary_path

TEXTS = ["end <|endoftext|> go", "<|endoftext|>", "a<|endoftext|>b  c", "no token < |endoftext|> here", " <|endoftext|><|endoftext|> x", "plain words", "", None]


def plain_call(texts):
    t = Tokenizer.from_file(vocabulary_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_encoder_equals_the_plain_call(prose):
    texts = [*TEXTS, prose(50, 71) + "<|endoftext|>" + prose(50, 72), prose(50, 71)]
    for _ in range(2):
        flat, at = encoder().encode(pa.array(texts, pa.string()))
        assert [flat[i:j].astype("<u4").tobytes() for i, j in zip(at, at[1:])] == plain_call(texts)
    assert encoder().encode(pa.array(["end <|endoftext|> go"]))[0].tolist() == [437, 220, 50256, 467]


def test_token_operators_take_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    end = np.array([END_ID], "<u4").tobytes()
    want = {i: (len(x) // 4 + 1, zlib.crc32(x + end)) for i, x in enumerate(plain_call(TEXTS))}
    path = new_path(spark, "files")
    token_files.write_token_files(docs, path, partitions=2)
    files = token_files.with_crc32(token_files.read_token_files(spark, path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in files} == want
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in best_fit_packing.pack(docs).collect()} == want
    lengths = [n - 1 for n, _ in want.values()]
    assert {r["length"]: r["docs"] for r in length_histogram.length_histogram(docs).collect()} == {n: lengths.count(n) for n in lengths}
