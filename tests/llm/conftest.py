import pytest


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(4)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(2500)]
