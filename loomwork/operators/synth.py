"""Synthetic spelling and letter-counting conversations over a word table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.functions.text import hash60
from loomwork.operators.running import hash_block, with_ordinal

# Seed offset of the test split, alphabet, quotes, question wordings.
TEST_SEED_OFFSET = 10_000_000
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
QUOTES = ["", "'", '"']
QUESTIONS = [
    "How many {letter} are in the word {word}",
    "How many {letter} are in {word}",
    "Count the number of {letter} in {word}",
    "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}",
    "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}",
    "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}",
    "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}",
    "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}",
    "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}",
    "Count all the {letter} in {word}",
    "How many times is {letter} in {word}",
    "Number of {letter} in {word}",
    "Total count of {letter} in {word}",
    "How many {letter} does {word} have",
    "How many {letter} does {word} contain",
    "What's the number of {letter} in {word}",
    "{word} has how many {letter}",
    "In {word}, count the {letter}",
    "How many {letter} appear in {word}",
    "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}",
    "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}",
    "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?",
    "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}",
    "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}",
    "{word}里有几个{letter}",
    "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}",
    "{word}에 {letter}가 몇 개 있나요",
    "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요",
    "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}",
    "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}",
    "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor",
    "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか",
    "{word}の中に{letter}がいくつ",
    "{word}に{letter}が何回出てくる",
]


def _draw(seed: Column, purpose: str, n: Column | int) -> Column:
    """Seeded choice in 0..n-1."""
    return F.pmod(hash60(seed, F.lit(purpose)), F.lit(n) if isinstance(n, int) else n)


def spelled(word: Column) -> Column:
    return F.array_join(F.split(word, ""), ",")


def pick_words(indices: DataFrame, words: DataFrame, split: str = "train") -> DataFrame:
    """(index, seed, word): a seeded word for each index.

    Words are numbered in hash order; the choice is then an equi-join.
    """
    hashed = words.withColumn("__h", hash60("word"))
    block = hash_block(words.sparkSession, "__h")
    numbered = with_ordinal(hashed, "__h", "__slot", block=block, ties=["word"]).drop("__h")
    n_words = words.count()
    seeded = indices.withColumn(
        "seed", F.col("index") + F.lit(TEST_SEED_OFFSET if split == "test" else 0)
    )
    chosen = seeded.withColumn("__slot", _draw(F.col("seed"), "word", n_words))
    return chosen.join(numbered, "__slot").select("index", "seed", "word")


def spelling(picked: DataFrame) -> DataFrame:
    word = F.col("word")
    return picked.select(
        "index",
        F.concat(F.lit("Spell the word: "), word).alias("user"),
        F.concat(word, F.lit(":"), spelled(word)).alias("assistant"),
    )


def letter_counting(picked: DataFrame) -> DataFrame:
    """(index, word, letter, count, user, parts)."""
    seed, word = F.col("seed"), F.col("word")
    own = F.substring(word, (1 + _draw(seed, "own", F.length(word))).cast("int"), F.lit(1))
    other = F.substring(F.lit(ALPHABET), (1 + _draw(seed, "other", 26)).cast("int"), F.lit(1))
    rows = picked.withColumn("letter", F.when(_draw(seed, "from_word", 10) < 9, own).otherwise(other))
    letter = F.col("letter")

    def hits(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    rows = rows.withColumn("count", hits(word).cast("bigint"))
    count = F.col("count").cast("string")

    asked = F.get(F.array(*[F.lit(q) for q in QUESTIONS]), _draw(seed, "question", len(QUESTIONS)).cast("int"))
    asked = F.when(_draw(seed, "lower", 10) < 3, F.lower(asked)).otherwise(asked)
    quotes = F.array(*[F.lit(q) for q in QUOTES])

    def quoted(text: Column, purpose: str) -> Column:
        mark = F.get(quotes, _draw(seed, purpose, 3).cast("int"))
        return F.concat(mark, text, mark)

    user = F.replace(asked, F.lit("{letter}"), quoted(letter, "letter_quote"))
    user = F.replace(user, F.lit("{word}"), quoted(word, "word_quote"))
    user = F.concat(user, F.when(_draw(seed, "mark", 2) == 0, "?").otherwise(""))

    def line(i: Column) -> Column:
        char = F.substring(word, i, F.lit(1))
        so_far = hits(F.substring(word, F.lit(1), i))
        hit = F.concat(F.lit(" hit! count="), so_far.cast("string"))
        return F.concat(i.cast("string"), F.lit(":"), char, F.when(char == letter, hit).otherwise(""), F.lit("\n"))

    manual = F.concat(
        F.lit("We are asked to find the number '"), letter, F.lit("' in the word '"), word,
        F.lit("'. Let me try a manual approach first.\n\nFirst spell the word out:\n"),
        word, F.lit(":"), spelled(word),
        F.lit("\n\nThen count the occurrences of '"), letter, F.lit("':\n"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(word)), line), ""),
        F.lit("\nThis gives us "), count, F.lit("."),
    )

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    parts = F.array(
        part("text", manual),
        part("text", F.lit("\n\nLet me double check this using Python:\n\n")),
        part("python", F.concat(F.lit("'"), word, F.lit("'.count('"), letter, F.lit("')"))),
        part("python_output", count),
        part("text", F.concat(F.lit("\n\nPython gives us "), count, F.lit(".\n\nMy final answer is:\n\n#### "), count)),
    )
    return rows.select("index", "word", "letter", "count", user.alias("user"), parts.alias("parts"))
