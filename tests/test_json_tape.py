import json
import random

import numpy as np
import pyarrow as pa

from logweave.functions.json_tape import Tape, lexical_states


def strict(text):
    def no(_):
        raise ValueError

    try:
        return isinstance(json.loads(text, parse_constant=no), dict)
    except ValueError:
        return False


def test_agrees_with_a_strict_parser():
    rng = random.Random(5)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"type"', "1", "-0", "01", "true", "nul", " ", '"\\u12', '"\\n"', "1e5", "1.", '"x', "\\", '{"a":1}', "[1,2]", "\x01", "é", "{}", "NaN"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    tape = Tape(pa.array(texts))
    for i, t in enumerate(texts):
        if t.strip(" \t\r\n"):
            assert bool(tape.ok[i]) == strict(t), t
        else:
            assert tape.blank[i]


def test_chunks_do_not_matter():
    data = np.frombuffer(b'{"a":"b\\\\","c":"\\""}\xff"open \xff{"x":1}\xff', np.uint8)
    for chunk in (1, 2, 5, 64):
        assert (lexical_states(data, chunk) == lexical_states(data)).all()


def test_last_key_counts_and_escaped_keys_match():
    tape = Tape(pa.array(['{"type":"a","ty\\u0070e":"b"}', '{"type":1}', None, ""]))
    got = tape.strings(tape.get(tape.member("type"), tape.root)).to_pylist()
    assert got == ["b", None, None, None] and list(tape.blank) == [False, False, True, True]
