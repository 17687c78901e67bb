"""Values that the tests share.  Tests import this module, never a conftest: there are several of those."""

SF = "/root/testdata/sf0.001"
