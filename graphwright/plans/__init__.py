"""Query front-ends that build DataFrame plans."""
