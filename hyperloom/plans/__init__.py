"""Ready-made plans: queries over the test tables."""
