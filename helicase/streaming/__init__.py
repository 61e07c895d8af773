"""The same operators over streams of reads."""
