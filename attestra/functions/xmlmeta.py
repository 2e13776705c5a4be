"""Scene metadata XML: solar zenith and per-band calibration.

Each document is parsed once, and equal ones of an Arrow batch together, to the few texts that matter;
the rules on those texts are columns. (The JVM's ``xpath`` function parses the
document anew for every path and took about a hundred times as long.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from attestra import fixed_values as fixed
from attestra.functions.numeric import finite_or_null


def _named(root, name: str):
    return (element for element in root.iter() if str(element.tag).rpartition("}")[2] == name)


def _texts(elements) -> list[str]:
    return sorted({e.text.strip() for e in elements if e.text and e.text.strip()})


def _root(document: str | None):
    try:
        return None if document is None else ElementTree.fromstring(document)
    except ElementTree.ParseError:
        return None


_TEXTS = T.ArrayType(T.StringType())
_PARTS = ("quantification", "B04", "B08", "nodata")
_CALIBRATION = T.StructType([T.StructField(n, _TEXTS) for n in _PARTS])


def _parsed_once(documents: Iterator[pa.Array], one: Callable[[str | None], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """Equal documents of a batch are parsed once."""
    for batch in documents:
        distinct = batch.dictionary_encode(null_encoding="encode")
        yield pa.array([one(d) for d in distinct.dictionary.to_pylist()], kind).take(distinct.indices)


@F.arrow_udf(_TEXTS)
def _zenith_texts(documents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(document):
        root = _root(document)
        if root is None:
            return []
        return sorted({t for mean in _named(root, "Mean_Sun_Angle") for t in _texts(_named(mean, "ZENITH_ANGLE"))})

    yield from _parsed_once(documents, one, pa.list_(pa.string()))


@F.arrow_udf(_CALIBRATION)
def _calibration_texts(documents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(document):
        root = _root(document)
        if root is None:
            return dict.fromkeys(_PARTS, [])
        offsets = list(_named(root, "BOA_ADD_OFFSET"))
        of_band = lambda band: _texts(e for e in offsets if e.get("band_id") == fixed.BAND_IDS[band])
        nodata = set()
        for special in _named(root, "Special_Values"):
            label = _texts(_named(special, "SPECIAL_VALUE_TEXT"))
            if label and label[0].upper() == "NODATA":
                nodata.update(_texts(_named(special, "SPECIAL_VALUE_INDEX")))
        return dict(zip(_PARTS, (_texts(_named(root, "BOA_QUANTIFICATION_VALUE")), of_band("B04"), of_band("B08"), sorted(nodata))))

    yield from _parsed_once(documents, one, pa.struct([(name, pa.list_(pa.string())) for name in _PARTS]))


def _only_number(texts: Column) -> Column:
    """The number when there is exactly one text and it is finite."""
    return F.when(F.size(texts) == 1, finite_or_null(F.get(texts, F.lit(0)).try_cast("double")))


def solar_zenith(xml: Column) -> Column:
    return _only_number(_zenith_texts(xml))


def calibration_texts(xml: Column) -> Column:
    """The distinct texts of quantification, both bands' offsets and nodata."""
    return _calibration_texts(xml)


def radiometry(texts: Column, band: str) -> Column:
    """Calibration of one band from its texts; NULL when a part is missing or contradictory."""
    quantification = _only_number(texts["quantification"])
    offsets = F.array_distinct(F.transform(texts[band], lambda v: finite_or_null(v.try_cast("double"))))
    nodata = F.array_distinct(F.transform(texts["nodata"], lambda v: v.try_cast("double")))
    declared = F.size(offsets) > 0
    usable = (
        quantification.isNotNull()
        & (F.size(offsets) <= 1)
        & ~F.exists(offsets, lambda v: v.isNull())
        & (F.size(nodata) == 1)
        & F.get(nodata, F.lit(0)).isNotNull()
    )
    return F.when(
        usable,
        F.struct(
            (F.lit(1.0) / quantification).alias("scale"),
            F.when(declared, F.get(offsets, F.lit(0)) / quantification).otherwise(F.lit(0.0)).alias("offset"),
            quantification.alias("quantification_value"),
            F.get(nodata, F.lit(0)).alias("nodata"),
            F.when(declared, F.lit("PRODUCT_XML:BOA_QUANTIFICATION_VALUE+BOA_ADD_OFFSET"))
            .otherwise(F.lit("PRODUCT_XML:BOA_QUANTIFICATION_VALUE+SCHEMA_DEFAULT_ZERO_OFFSET"))
            .alias("metadata_source"),
            F.lit("PASS").alias("cross_check"),
        ),
    )
