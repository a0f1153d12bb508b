"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .bpe import op13_bpe
from .cws import op3_fingerprints
from .decontamination import op6_decontamination
from .licenses import op1_licenses
from .linededup import OP5_SQL, op5_linededup
from .mixing import OP7_SQL, op7_mixing
from .pii import op10_pii
from .sharding import op2_sharding
from .simhash import op9_simhash
from .spelling import OP11_SQL, op11_spelling
from .toxicity import op4_toxicity
from .urlfilter import OP8_SQL, op8_urlfilter
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_licenses, op2_sharding, op3_fingerprints, op4_toxicity, op5_linededup, op6_decontamination, op7_mixing, op8_urlfilter, op9_simhash, op10_pii, op11_spelling, op12_whitening, op13_bpe)}
SQL = {"op5_linededup": OP5_SQL, "op7_mixing": OP7_SQL, "op8_urlfilter": OP8_SQL, "op11_spelling": OP11_SQL}
