"""Which words the toxic dictionary takes."""

from gleaner.llm import toxicity
from gleaner.session import ship_package


def _documents(times):
    """200 toxic documents and 800 others: 600 telling words in 20 toxic documents each, one in 199, and a common word in more of the toxic ones."""
    rows = []
    for k in range(times):
        for i in range(1000):
            bad = i < 200
            words = [f"telling{j}" for j in range(600) if bad and j % 10 == i % 10]
            words += ["always"] if bad and i else []
            words += ["common"] if i % 20 < (16 if bad else 12) else []
            rows.append((" ".join(words), int(bad)))
    return rows


def test_every_telling_word_is_taken_and_common_ones_never(spark):
    ship_package(spark)
    for times in (1, 5):
        rows = spark.createDataFrame(_documents(times), "text string, toxic int")
        toxic, _ = toxicity._dictionaries(rows, 200 * times, 800 * times)
        words = toxic.decode().split()
        assert set(words) == {"always", *(f"telling{j}" for j in range(600))}  # more than 2,048 bytes, the same at either size
        assert words[-1] == "always"  # the most telling word is last
