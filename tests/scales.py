"""Data folders of the tests, under a module name that no other folder of tests uses."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
