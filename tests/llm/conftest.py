import random

import pytest


@pytest.fixture
def prose():
    """Random texts of invented words, the same in every run."""
    rng = random.Random(11)
    syllables = ["an", "ber", "co", "du", "el", "fi", "gor", "ha", "is", "jo", "ka", "lu"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    text.rng = rng
    return text
