from .readers import READERS, envelope, ingest, ingest_log, load_catalog, read_source, reader, register

__all__ = ["READERS", "envelope", "ingest", "ingest_log", "load_catalog", "read_source", "reader", "register"]
