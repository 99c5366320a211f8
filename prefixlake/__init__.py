"""prefixlake: prompt- and prefix-cache analytics as DataFrame operators."""
