"""Word ids encoded in runs are the tokenizer's own."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from linkloom.llm.packing import WordIds


def test_runs_of_words_keep_their_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["İstanbul don't l'été's naïve, école--- a'b ''s x's", "ﬁne ½ Ω K Å, <|endoftext|> foo<|endoftext|>bar,", "", "日本語, 中文 한국어! ªº ˈa", "it's, 'tis' rock'n'roll' we'll' s'",
             "\u0085a b　c, ​d ﬃ, ǅ ét́e"] + [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}x{',' * (j % 3)}" for j in range(26)) for i in range(26)]
    got = WordIds(path, 1000).ids([t.encode() for t in texts])
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_counts_of_the_same_long_run_in_two_texts(spark):
    import public_tokenizers
    import tokenizers
    from linkloom.llm import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    run = "".join(chr(97 + i * i % 26) for i in range(150_000))
    texts = [run, "a " + run, "b"]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    tok = tokenizers.Tokenizer.from_file(path)
    assert [r["n_tokens"] for r in got] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokenizers_of_another_pattern_are_refused():
    import pytest
    import public_tokenizers
    import tokenizers
    from linkloom.llm import token_counts

    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_counts.check_pattern(tok)
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace()
    with pytest.raises(ValueError):
        token_counts.check_pattern(tok)
