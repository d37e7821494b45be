"""Folders of the driver's tables, for tests (a module of its own: several conftest.py may exist)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
