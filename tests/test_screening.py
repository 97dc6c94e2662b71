import random

import pytest
from pyspark.sql import functions as F

from docscreen import constants as C
from docscreen.functions.skills import SkillIndex, find_skill_matches, find_skills, skill_vocabulary, with_skills
from docscreen.operators import screening

REQUIREMENTS = {"Data Engineer": ["SQL", "Python", "ETL", "C++"], "Tester": ["Java", "sql"]}


@pytest.mark.parametrize("text, expected", [
    ("Java in JavaScript", ["Java"]), ("only JavaScript", []), ("C++, x", ["C++"]),
    ("c#.", ["C#"]), ("AWS and node", ["AWS"]), ("gitlab", []), ("Vue.js, git", ["Git", "Vue.js"]),
    ("machine\nlearning", []), ("Machine Learning", ["Machine Learning"]), ("", []), (None, []),
    ("etl SQL", ["ETL", "sql"])])
def test_find_skills(evaluate, text, expected):
    vocabulary = skill_vocabulary(REQUIREMENTS)
    assert evaluate(find_skills(F.col("text"), vocabulary), text=text) == expected


@pytest.mark.parametrize("shared_bytes", [1 << 26, 0])
def test_skills_of_a_table_equal_the_literal_way(spark, shared_bytes):
    random.seed(4)
    words = ["data", "sql", "c++", "c#", ".net", "r&d", "node", "js", "é", "ⅷ", "a_b", "++", "x-1", "Ünï", "c", "go"]
    gaps = [" ", "  ", "-", ".", ", ", "\n", "\u2003", "/", ""]
    vocabulary = {}
    while len(vocabulary) < 200:
        skill = random.choice(words) + "".join(random.choice(gaps[:5]) + random.choice(words) for _ in range(random.randrange(3)))
        vocabulary[skill.lower()] = skill.title()
    texts = [None, "", " ", "c++", "xc++", "c++x", "c++ .net", "a.net", "\x85.net\x1c", "++", "a++", " ++ "]
    texts += ["".join(random.choice(words) + random.choice(gaps) for _ in range(random.randrange(25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([*vocabulary.items(), (None, "x"), ("", "y")], "skill string, name string")
    got = {r.doc_id: r.skills for r in with_skills(df, "text", table, shared_bytes=shared_bytes).collect()}
    expected = {r.doc_id: r.skills for r in df.select("doc_id", find_skills(F.col("text"), vocabulary).alias("skills")).collect()}
    assert got == expected and sum(map(len, expected.values())) > 200


def test_large_skill_tables(spark):
    """Tens of thousands of entries; a text only meets those that it shares words with."""
    entries = [(f"skill{i} part{i % 97}", f"S{i}") for i in range(50_000)]
    index = SkillIndex.of(entries)
    assert max(map(len, index.entries.values())) == 1
    table = spark.createDataFrame(entries, "skill string, name string")
    df = spark.createDataFrame([(i, f"x skill{i} part{i % 97}, skill{i + 1}  part{(i + 1) % 97}") for i in range(300)],
                               "doc_id long, text string")
    assert all(r.skills == [f"S{r.doc_id}"] for r in with_skills(df, "text", table).collect())


def test_skill_matches(evaluate):
    got = evaluate(find_skill_matches(F.col("text")), text=(
        "React, Node.js, nodejs and PostgreSQL, postgres; c++ CPP R&D .NET; natural language "
        "processing NLP nlp Researcher"))
    assert got["Node.js"] == ["Node.js", "nodejs"]
    assert got["PostgreSQL"] == ["PostgreSQL", "postgres"]
    assert got["C++"] == ["c++", "CPP"] and got[".NET"] == [".NET"]
    assert got["NLP"] == ["natural language processing", "NLP"] and got["R"] == ["R"]
    assert "Java" not in got and "Scala" not in got


def screened(spark, rows, requirements=REQUIREMENTS):
    df = spark.createDataFrame(rows, "text string, role string, confidence double")
    return screening.screen(df, "text", "role", "confidence", skill_vocabulary(REQUIREMENTS),
                            requirements)


def test_score_components(spark):
    rows = screened(spark, [
        ("plain", "Nobody", None), ("plain", "Nobody", 0.0),
        ("SQL python years of experience, university", "Data Engineer", 0.2),
        ("x", "Tester", 0.9)]).collect()
    parts = [{n: getattr(r.screening_breakdown.components, n).score_pct for n in C.WEIGHTS}
             for r in rows]
    low = {"role_match": 50, "skills_match": 50, "experience_match": 40, "education_match": 30}
    assert parts[0] == low and parts[1] == low
    assert parts[2] == {"role_match": 70, "skills_match": 50, "experience_match": 80,
                        "education_match": 90}
    assert rows[2].missing_common_skills == ["ETL", "C++"]
    assert parts[3]["role_match"] == 100 and parts[3]["skills_match"] == 0
    total = min(1.0, 0.2 * 3.5) * 0.4 + 0.5 * 0.4 + 0.8 * 0.15 + 0.9 * 0.05
    assert rows[2].screening_breakdown.final_score_pct == round(total * 100)


def test_requirements_table_equals_dictionary(spark):
    table = spark.createDataFrame(list(REQUIREMENTS.items()), "role string, skills array<string>")
    rows = [("sql", "Tester", 0.1), ("java", "Nobody", 0.1), ("etl", "Data Engineer", 0.1)]
    assert sorted(map(str, screened(spark, rows).collect())) == sorted(
        map(str, screened(spark, rows, table).collect()))


@pytest.mark.parametrize("role, category", [
    ("HR Manager", "hr"), ("Senior Data Analyst", "data"), ("Web Developer", "web"),
    ("Python Developer", "python"), ("Full-Stack Developer", "software"), ("Chef", "generic"),
    ("chrome", "generic"), (None, "generic")])
def test_catalogue_category(evaluate, role, category):
    assert evaluate(screening.catalogue_category(F.col("role")), role=role) == category


def test_catalogue_match(spark):
    df = screened(spark, [("Python and SQL, data analysis, degree, years", "Data Analyst", 0.9)])
    rows = {r.entry_name: r for r in screening.catalogue_match(df, role="role").collect()}
    assert len(rows) == 6
    tiger = rows["Tiger Analytics"]  # two detected, so the text does not add to them
    assert tiger.matches == ["Python", "sql"]
    assert tiger.reasons == ["Python", "sql", "Relevant experience signal"]
    assert tiger.score == min(94, 70 + 8 + 4 + 3 + 2)
    deloitte = rows["Deloitte"]  # one detected, one found in the text
    assert deloitte.matches == ["sql", "Data Analysis"]


def test_catalogue_alignment(spark):
    df = screened(spark, [("nothing", "Chef", None)])
    row = screening.catalogue_match(df, role="role").first()
    assert row.reasons == ["Chef alignment", "Experience considered"] and row.score == 74


def test_entries_are_found_in_slices_of_a_batch(spark, capsys):
    """More texts than a task holds the entries of at once; a column of that name is replaced."""
    table = spark.createDataFrame([("a b", "A B"), ("c", "C")], "skill string, name string")
    rows = [(i, None if i % 7 == 0 else "A b, c" if i % 2 else "x", "old") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id int, text string, skills string").coalesce(1)
    found = with_skills(df, "text", table)
    assert found.columns == ["doc_id", "text", "skills"]
    assert [(r.doc_id, r.text, r.skills) for r in found.orderBy("doc_id").collect()] == [
        (i, t, ["A B", "C"] if t == "A b, c" else []) for i, t, _ in rows]
    found.explain()
    assert "MapInArrow" in capsys.readouterr().out
