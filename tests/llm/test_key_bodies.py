"""Masks over whole keys in PEM blocks."""

import pytest

import corpus_pipeline as pipeline

KEY = "\n".join(["MIIEpAIBAAKCAQEA0Zz4bq+T/9dKx3VgPq1cJw7uLhYt2RfSnE5mOa8BiD6kXyGv"] * 3 + ["Qm9keQ=="])


def head(kind=""):
    return f"-----BEGIN {kind}PRIVATE KEY-----"


def tail(kind=""):
    return f"-----END {kind}PRIVATE KEY-----"


@pytest.mark.parametrize("text,masked", [
    (f"a\n{head()}\n{KEY}\n{tail()}\nb", "a\n[SECRET]\nb"),
    (f"{head('RSA ')}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{KEY}\n{tail('RSA ')} b", "[SECRET] b"),
    (f"{head('RSA ')}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{KEY}\nhere. It ends", "[SECRET]\nhere. It ends"),
    (f'k = "{head()}\\n{KEY}\\n".replace', 'k = "[SECRET]\\n".replace'),
    (f'\U0001F600 "{head("EC ")}\\n' + KEY.replace("\n", "\\n") + f'\\n{tail("EC ")}\\n" é', '\U0001F600 "[SECRET]\\n" é'),
    (f"{head()}\n{KEY}\n{tail()} mid {head()}\n{KEY}\nand so on", "[SECRET] mid [SECRET]\nand so on"),
    (f"{head()} {head()}\n{KEY}\n{tail()}", "[SECRET] [SECRET]"),
    (f"the line {head()} starts a key, e.g. one of mine", "the line [SECRET] starts a key, e.g. one of mine"),
    (f"{head()}\r\n{KEY}\r\n", "[SECRET]\r\n"),
    (head(), "[SECRET]"),
])
def test_keys_are_masked_with_their_bodies(spark, text, masked):
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pipeline.mask_secrets(spark, docs, "").collect()] == [(1, masked, len(masked))]
