"""veilstream: detection, redaction and audit of sensitive text as Spark plans."""
