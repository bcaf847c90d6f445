"""glossa: text analytics and indicative summarization as Spark DataFrame plans."""
