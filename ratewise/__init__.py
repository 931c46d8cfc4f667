"""ratewise: review-rating analytics on Spark.

Rating prediction (bias removal + ALS on the residual, baselines, strata,
cold-start fallback), geo clustering (KMeans, silhouette, profiles) and
rating-matrix analysis (distributed truncated SVD, PCA, projections), all
expressed as DataFrame / pyspark.ml jobs.
"""

__version__ = "0.1.0"
