"""Lexicons: labels in order, each with keywords that are looked for as substrings of lower-cased text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lexicon:
    """Labels with their keywords; the order of labels decides where the first match wins."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, entries: Mapping[str, Iterable[str]]) -> "Lexicon":
        return cls(tuple((k, tuple(v)) for k, v in entries.items()))

    @classmethod
    def parse(cls, lines: str) -> "Lexicon":
        """A lexicon of lines "label: word | word"."""
        return cls.of({k.strip(): [w.strip() for w in ws.split("|")] for k, _, ws in (x.partition(":") for x in lines.strip().splitlines())})

    @property
    def labels(self) -> list[str]:
        return [k for k, _ in self.entries]

    @property
    def keywords(self) -> list[str]:
        return [w for _, ws in self.entries for w in ws]

    def frame(self, spark: SparkSession, name: str = "") -> DataFrame:
        """The lexicon as a table, for joins."""
        rows = [(name, label, i, w, j) for i, (label, ws) in enumerate(self.entries) for j, w in enumerate(ws)]
        return spark.createDataFrame(rows, "lexicon string, label string, label_ord int, keyword string, kw_ord int")

    def any_sql(self, label: str, text: str = "t") -> str:
        return any_sql(dict(self.entries)[label], text)


def any_sql(words: Iterable[str], text: str = "t") -> str:
    """DuckDB: whether text has any of the words."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def count_sql(words: Iterable[str], text: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def any_of(low: Column, words: Iterable[str]) -> Column:
    """Whether lower-cased text has any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def count_of(low: Column, words: Iterable[str]) -> Column:
    """How many different words of the list the text has."""
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is computed once a row however often it's named; a lower case would be made anew for each keyword."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def labels_of(low: Column, lexicon: Lexicon) -> Column:
    """Array of the labels with a hit, in lexicon order."""
    return once(low, lambda t: F.filter(F.array(*[F.when(any_of(t, ws), F.lit(k)) for k, ws in lexicon.entries]), lambda x: x.isNotNull()))


def first_label(low: Column, lexicon: Lexicon, default: str = "general") -> Column:
    return F.coalesce(*[F.when(any_of(low, ws), F.lit(k)) for k, ws in lexicon.entries], F.lit(default))


#: Substrings that the fixture texts have; FIXTURES.md counts their hits.
CONDITIONS = Lexicon.of({"aim": ["aim"], "heat": ["heat", "wheat"], "data": ["data", "license"], "east": ["east", "near"], "art": ["art"]})
INTERVENTIONS = Lexicon.of({"hand": ["hand"], "test": ["test", "best"], "ation": ["ation"]})
POPULATIONS = Lexicon.of({"ness": ["ness"], "tone": ["tone", "stone"], "para": ["para"], "hero": ["hero"]})
HUB = ("of the", "and in", "rest", "there")
WEIGHTED = (("of the", 3.0), ("and in", 2.5), ("rest", 2.0), ("there", 1.5), ("hand", 1.5), ("aim", 1.0))
TOPICS = Lexicon.of({**dict(CONDITIONS.entries), **dict(INTERVENTIONS.entries), **dict(POPULATIONS.entries)})

#: Health-grant lexicons; pass them where the texts are of that domain.
HEALTH_CONDITIONS = Lexicon.parse("""
diabetes: diabet | glycemic | hba1c | insulin
hypertension: blood pressure | cardiovascular | heart disease | hypertension | stroke | systolic
depression: antidepressant | depressi | phq-9
anxiety: anxiety | gad-7 | panic disorder
HIV: aids | antiretroviral | art | hiv | prep
asthma: asthma | bronchial | inhaler | pulmonary
cancer: cancer | carcinoma | colonoscopy | mammography | oncology | tumor
obesity: bmi | obesity | overweight | weight loss
substance_use: addiction | alcohol use | buprenorphine | drug use | naloxone | opioid | substance use
social_determinants: food insecurity | housing instability | sdoh | social determinants | social needs
""")
HEALTH_INTERVENTIONS = Lexicon.parse("""
CHW: chw | community health educator | community health worker | lay health advisor | promotora
telehealth: mhealth | mobile health | remote monitoring | telehealth | telemedicine | virtual visit
navigation: care coordination | care manager | navigator | patient navigation
screening: early detection | health screening | preventive screening | screening program
education: health education | health literacy | patient education | self-management
behavioral: behavioral intervention | cbt | cognitive behavioral | counseling | motivational interviewing
medication: medication adherence | medication management | pharmacist
integrated_care: behavioral health integration | co-located | collaborative care | integrated care
""")
HEALTH_POPULATIONS = Lexicon.parse("""
Latino: hispanic | latino | latinx | promotora | spanish speaking
African_American: african american | african-american | black
pediatric: adolescent | child health | children | pediatric | school based | youth
geriatric: aging | elderly | geriatric | older adult | senior
rural: appalachian | frontier | rural
low_income: economically | low income | low-income | poverty | underserved
Medicaid: medicaid | safety-net | underinsured | uninsured
LGBTQ: lgbtq | msm | sexual minority | transgender
""")
HEALTH_HUB = ("community health center", "fqhc", "federally qualified health center", "health disparities", "medically underserved", "safety-net clinic")
HEALTH_WEIGHTED = (("medicaid", 1.5), ("uninsured", 1.5), ("low-income", 1.5), ("primary care access", 1.5), ("health disparities", 2.0), ("medically underserved", 2.0), ("safety-net clinic", 2.5), ("community health center", 2.5), ("fqhc", 3.0), ("federally qualified health center", 3.0))
