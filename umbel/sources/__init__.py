"""Readers and writers: tables with declared schemas, image catalogues, annotations, keyed stores, vector files."""
