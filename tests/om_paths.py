"""Folders of the test tables (a module of its own: ``conftest`` names several files)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
