"""PCM as stored: any samples come back, and those on a G.711 grid take one byte for two."""

import numpy as np
import pytest

from hyperloom.llm import audio


@pytest.mark.parametrize("kind", ["mulaw", "alaw", "any"])
@pytest.mark.parametrize("count", [0, 1, 2, 3, 191, 384])
def test_stored_pcm(kind, count):
    rng = np.random.default_rng(count)
    samples = audio.TABLES[kind][rng.integers(0, 256, count)] if kind != "any" else rng.integers(-32768, 32768, count).astype(np.int16)
    wide = audio.resample(samples)
    assert np.array_equal(audio.grow_pcm(audio.shrink_pcm(samples)), samples)
    stored = audio.shrink_pcm(wide)
    assert np.array_equal(audio.grow_pcm(stored), wide)
    # The odd samples of a doubled rate are all predicted.
    assert len(stored) == 1 + (3 if kind != "any" or not count else 4) * count and not any(stored[1 + (1 if kind != "any" else 2) * count :])
