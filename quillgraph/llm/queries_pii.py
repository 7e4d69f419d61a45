"""op9: documents with surrogates for personal data."""

from .common import table
from .pii import pseudonymize

#: Key of the registered query; a deployment passes its own secret.
KEY = "demonstration key"


def op9_pii_surrogates(spark, sf_dir):
    return pseudonymize(table(spark, sf_dir, "documents"), KEY)


QUERIES = {"op9_pii_surrogates": op9_pii_surrogates}
ORACLE: dict[str, str] = {}  # keyed surrogates have no SQL form: tests compare with a plain version
