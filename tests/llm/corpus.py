"""A small corpus with everything that operators have to bear."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, spans string, key string, row string, _row string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    out = [prose(r.randint(1, 300)) for _ in range(60)]
    passage = prose(60)
    for k in range(8):
        out[k] = out[k] + "\n" + passage + "\n" + prose(20)
    base = prose(250).split(" ")
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k % 4):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        out.append(" ".join(copy))
    out += [out[3]] * 5 + ["ab " * 400, "x", "", "   \n\t ", "#$% <|> 1 2 3", "Z" * 5000, "same line\n" * 60, "one two three", "ONE TWO three", "   wide", "é" * 300]
    out.append(prose(6000))  # longer than the others by far
    return out


def rows(seed=1):
    found = [(k, t, "en", "src0", len(t), k, "s", "k", "r", "x") for k, t in enumerate(texts(seed))]
    found.append(found[4])  # a repeated row
    found += [(900, None, None, None, None, None, None, None, None, None), (None, "a text without an id, long enough to have windows of words in it and some more words", "en", None, None, None, None, None, None, None)]
    return found


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
