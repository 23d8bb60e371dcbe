"""Set-at-a-time operators: samples, copies, histograms, profiles, tests, metrics."""
