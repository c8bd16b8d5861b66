"""The walks of operator 1 against steps taken one by one."""

import numpy as np

from duskwatch.llm import decontamination


def test_embeddings_agree_as_walked_step_by_step():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(np.frombuffer(b"abcde  ", np.uint8), n)) for n in (40, 90, 200, 400)]
    items = decontamination.Items(list(range(4)), texts, 80)
    buf, _ = decontamination.normalised([texts[3][:150] + texts[2], texts[1]])
    starts = decontamination.windows(buf)
    window, place = (x.ravel() for x in np.meshgrid(np.arange(len(items.starts)), np.arange(len(starts))))
    got = decontamination.agreements(items, window, decontamination.embedded(buf, starts, decontamination.COMPARED[0], 1), buf, starts, place)
    for k in range(0, len(window), 7):
        p, q, same, taken, want = items.starts[window[k]], starts[place[k]], 0, 0, None
        for step in range(decontamination.COMPARED[-1]):
            if step in decontamination.COMPARED and same < taken / 4 + decontamination.SPREAD[decontamination.COMPARED.index(step)] * taken**0.5:
                want = 0
                break
            x, y = items.buf[p], buf[q]
            taken, same = taken + int(x != 10), same + int(x == y != 10)
            p, q = p + decontamination.MOVES[0, step, x], q + decontamination.MOVES[0, step, y]
        if want is None:
            want = same if same >= taken / 4 + decontamination.SPREAD[-1] * taken**0.5 else 0
        assert got[k] == want
